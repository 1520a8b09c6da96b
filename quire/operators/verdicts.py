"""Claims that cite, what a judge says of them, and findings: decision tables around providers that answer in batches.

A provider is a function from a list of requests (dicts) to a list of answers (dicts or None), as a model or a rule gives
them. Each step asks only the rows that need it, and its answers are written once, so no row is asked twice.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import table_fragment
from quire.operators.evidence import locate_spliced, normal, remove_spans
from quire.operators.quantities import conflicts
from quire.session import cut

c = F.col
Provider = Callable[[list[dict]], list[dict | None]]
VERDICT = "label string, evidence string, off_topic boolean, rationale string, start int, end int, note string"
POSITIVE = ("supported", "partial", "unsupported")
ENDS = " \t\n。.!！?？,，;；"


def claims_of(sentence: str, marks: list[tuple[int, int, str]], told: list[dict] | None) -> list[tuple[int, int, str, list[str]]]:
    """(start, end, text, marker ids) of a sentence's claims.

    marks: places and ids of its markers; told: what a provider gave, texts with the tags m1, m2 of their markers. A claim
    whose text isn't in the sentence or says too little falls back to the whole sentence, as do markers without a claim.
    """
    bare, at = remove_spans(sentence, [(a, b) for a, b, _ in marks])
    form, places = normal(bare, spaces=False)
    tags = {f"m{i}": k for i, (_, _, k) in enumerate(marks, 1)}
    out, covered, open_ = [], set(), []
    for claim in told or ():
        ids = [tags[t] for t in map(str, claim.get("markers") or ()) if t in tags]
        want = normal(str(claim.get("text") or ""), spaces=False)[0]
        p = form.find(want) if want else -1
        if not ids:
            continue
        if p < 0 or len(want) < 8:
            open_ += [i for i in ids if i not in open_]
            continue
        start, end = at[places[p]], at[places[p + len(want) - 1]] + 1
        inside = [(a - start, b - start) for a, b, _ in marks if start <= a and b <= end]
        text = remove_spans(sentence[start:end], inside)[0]
        out.append((start, end, " ".join(text.split()), ids))
        covered.update(ids)
    open_ += [k for _, _, k in marks if k not in covered and k not in open_]
    kept = [i for i, ch in enumerate(bare) if ch not in ENDS]
    if open_ and kept:
        out.append((at[kept[0]], at[kept[-1]] + 1, " ".join(bare[kept[0] : kept[-1] + 1].split()), open_))
    return out


def extract_claims(sentences: DataFrame, markers: DataFrame, provider: Provider, *, batch: int = 8) -> DataFrame:
    """para_id, sent_ix, start_pos, end_pos, text, marker_ids of the claims of sentences that cite.

    sentences: para_id, sent_ix, start_pos, end_pos, text; markers: para_id, marker_id, start_pos, end_pos. The provider
    sees {"sentence": with tags in place of markers} and answers {"claims": [{"text", "markers"}]}. Equal tagged sentences
    are asked once, wherever they stand; flattened tables aren't asked.
    """
    m = markers.select("para_id", "marker_id", c("start_pos").alias("a"), c("end_pos").alias("b"))
    s = sentences.where("text IS NOT NULL").where(~table_fragment(c("text"), True))
    inside = s.join(m, "para_id").where("start_pos <= a AND b <= end_pos").groupBy("para_id", "sent_ix", "start_pos", "text").agg(F.array_sort(F.collect_set(F.struct((c("a") - c("start_pos")).cast("int").alias("a"), (c("b") - c("start_pos")).cast("int").alias("b"), "marker_id"))).alias("marks"))
    step = F.aggregate("marks", F.struct(F.lit("").alias("t"), F.lit(0).alias("at"), F.lit(1).alias("n")), lambda x, k: F.struct(F.concat(x["t"], F.substr(c("text"), x["at"] + 1, k["a"] - x["at"]), F.lit("⟦m"), x["n"].cast("string"), F.lit("⟧")).alias("t"), k["b"].alias("at"), (x["n"] + 1).alias("n")))
    tagged = inside.withColumn("x", step).withColumn("tagged", F.concat("x.t", F.substr(c("text"), c("x.at") + 1, F.length("text"))))

    def ask(batches):
        for some in batches:
            texts = some.column(0).to_pylist()
            answers = [a for k in range(0, len(texts), batch) for a in provider([{"sentence": t} for t in texts[k : k + batch]])]
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array([json.dumps((a or {}).get("claims") or []) for a in answers], pa.string())], ["tagged", "told"])

    told = cut(tagged.select("tagged").distinct().mapInArrow(ask, "tagged string, told string"))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()), ("marker_ids", pa.list_(pa.string()))]))

    def place(batches):
        for some in batches:
            rows = [[dict(zip(("start", "end", "text", "marker_ids"), x)) for x in claims_of(t, [(k["a"], k["b"], k["marker_id"]) for k in marks], json.loads(j))] for t, marks, j in zip(*(some.column(i).to_pylist() for i in (3, 4, 5)))]
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), some.column(2), pa.array(rows, kind)], ["para_id", "sent_ix", "start_pos", "claims"])

    kinds = {f.name: f.dataType.simpleString() for f in tagged.schema}
    rows = tagged.join(told, "tagged").select("para_id", "sent_ix", "start_pos", "text", "marks", "told").mapInArrow(place, f"para_id {kinds['para_id']}, sent_ix {kinds['sent_ix']}, start_pos {kinds['start_pos']}, claims array<struct<start:int,end:int,text:string,marker_ids:array<string>>>")
    return rows.select("para_id", "sent_ix", c("start_pos").alias("at"), F.explode("claims").alias("x")).select("para_id", "sent_ix", (c("at") + c("x.start")).alias("start_pos"), (c("at") + c("x.end")).alias("end_pos"), "x.text", "x.marker_ids")


def verdict(answer: dict | None, excerpt: str) -> tuple:
    """label, evidence, off_topic, rationale, start, end, note of one answer: what claims to rest on the source must quote it
    word for word. note: none (no answer), bare (no quote), lost (the quote isn't there), or null."""
    if answer is None:
        return None, None, False, None, None, None, "none"
    label, evidence, off, why = answer.get("label"), answer.get("evidence"), bool(answer.get("off_topic")), answer.get("rationale")
    if label not in POSITIVE:
        return "undetermined", evidence, off, why, None, None, None
    if not (evidence or "").strip():
        return "undetermined", None, off, "no evidence given", None, None, "bare"
    span = locate_spliced(evidence, excerpt)
    if span is None:
        return "undetermined", None, off, "evidence not in the source", None, None, "lost"
    return label, evidence, off, why, *span, None


def judged(rows: DataFrame, provider: Provider, task: str, *, batch: int = 5) -> DataFrame:
    """pair and a verdict for each row of pair, claim, excerpt, as checked against the excerpt; written once."""
    kind = rows.schema["pair"].dataType.simpleString()

    def ask(batches):
        types = [pa.string(), pa.string(), pa.bool_(), pa.string(), pa.int32(), pa.int32(), pa.string()]
        for some in batches:
            texts = list(zip(some.column(1).to_pylist(), some.column(2).to_pylist()))
            got = [a for k in range(0, len(texts), batch) for a in provider([{"task": task, "claim": x, "excerpt": e} for x, e in texts[k : k + batch]])]
            cols = list(zip(*(verdict(a, e) for a, (_, e) in zip(got, texts)))) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([some.column(0), *(pa.array(x, t) for x, t in zip(cols, types))], ["pair", *(x.split(" ")[0] for x in VERDICT.split(", "))])

    return cut(rows.select("pair", "claim", "excerpt").mapInArrow(ask, f"pair {kind}, {VERDICT}"))


def corrected(rows: DataFrame, first: DataFrame, provider: Provider, task: str) -> DataFrame:
    """first, with one more try for quotes that were not in the source; an answer that then fails leaves it undetermined."""
    again = judged(rows.join(first.where("note = 'lost'").select("pair"), "pair", "left_semi"), provider, task + "_again")
    return replaced(first, again.where("note IS NULL OR note <> 'none'"))


def replaced(rows: DataFrame, by: DataFrame) -> DataFrame:
    return rows.join(by.select("pair"), "pair", "left_anti").unionByName(by)


def cascade(pairs: DataFrame, provider: Provider, alternate: DataFrame | None = None) -> DataFrame:
    """pair, label, evidence, off_topic, rationale, start, end: whether a source supports a claim.

    pairs: pair, claim, excerpt, wide (a larger excerpt for the review; null: the same). The steps, each for the rows that
    need it: judge; once more where the quote isn't in the excerpt; review of partial and unsupported, and of supported
    where a number differs or a `details` answer quotes a contradiction that is there; review_fallback where the review
    gives nothing, else the first verdict stands; an off-topic hunch without evidence holds only if a review has it too.
    alternate (pair, excerpt, wide): a flagged verdict must be flagged on this other excerpt as well. Without an excerpt
    a pair is undetermined. Tasks a provider sees: judge, judge_again, details, review, review_again, review_fallback.
    """
    some = cut(pairs.where("claim IS NOT NULL AND excerpt IS NOT NULL AND excerpt <> ''").select("pair", "claim", "excerpt", F.coalesce("wide", "excerpt").alias("wide")))
    wide = some.select("pair", "claim", c("wide").alias("excerpt"))
    first = corrected(some, judged(some, provider, "judge"), provider, "judge")
    positive = some.join(first.where("label = 'supported'").select("pair"), "pair", "left_semi")
    doubt = judged(positive, provider, "details").where("label = 'unsupported'").select("pair")
    number = conflicts(positive.select("pair", "claim", c("excerpt").alias("source"))).select("pair")
    up = cut(first.where("label IN ('partial', 'unsupported')").select("pair").unionByName(doubt).unionByName(number).distinct())
    asked = wide.join(up, "pair", "left_semi")
    review = judged(asked, provider, "review")
    second = judged(asked.join(review.where("note = 'none'").select("pair"), "pair", "left_semi"), provider, "review_fallback")
    review = corrected(asked, replaced(review, second), provider, "review").where("note IS NULL OR note <> 'none'")
    got = cut(replaced(first, review).withColumn("label", F.coalesce("label", F.lit("undetermined"))))
    hunch = judged(wide.join(got.where("label = 'undetermined' AND off_topic").select("pair"), "pair", "left_semi"), provider, "review")
    sure = hunch.where("off_topic AND label IN ('unsupported', 'undetermined')").select("pair", F.lit(True).alias("sure"), c("rationale").alias("why"))
    got = got.join(sure, "pair", "left").withColumn("off_topic", (c("label") == "unsupported") & c("off_topic") | F.coalesce("sure", F.lit(False))).withColumn("rationale", F.coalesce("why", "rationale")).drop("sure", "why", "note")
    flagged = c("label").isin("partial", "unsupported") | c("off_topic")
    if alternate is not None:
        other = got.where(flagged).select("pair").join(alternate, "pair").join(some.select("pair", "claim", c("excerpt").alias("before")), "pair").where("excerpt <> before").select("pair", "claim", "excerpt", "wide")
        again = cascade(cut(other), provider)
        calm = again.where(~flagged).select("pair", F.lit(True).alias("calm"))
        keep = F.coalesce("calm", F.lit(False))
        got = got.join(calm, "pair", "left")
        got = got.select("pair", F.when(keep, "undetermined").otherwise(c("label")).alias("label"), F.when(~keep, c("evidence")).alias("evidence"), (c("off_topic") & ~keep).alias("off_topic"), F.when(keep, "not confirmed on another excerpt").otherwise(c("rationale")).alias("rationale"), F.when(~keep, c("start")).alias("start"), F.when(~keep, c("end")).alias("end"))
    none = pairs.join(some.select("pair"), "pair", "left_anti").select("pair", F.lit("undetermined").alias("label"), F.lit(None).cast("string").alias("evidence"), F.lit(False).alias("off_topic"), F.lit("no source").alias("rationale"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"))
    return got.unionByName(none)


def support_findings(claims: DataFrame, verdicts: DataFrame) -> DataFrame:
    """doc_id, rule, severity, para_id, start_pos, end_pos, refs, n_claims: what a manuscript's verdicts give cause to say.

    claims: pair, doc_id, para_id, start_pos, end_pos, ref_id. One row a pair: unsupported high (miscited where off topic),
    off topic medium, partial low; and one low row a manuscript for all references whose source was missing.
    """
    j = claims.join(verdicts, "pair")
    rule = F.when(c("label") == "unsupported", F.when(c("off_topic"), "miscited").otherwise("unsupported")).when(c("label") == "partial", "partly_supported").when(c("off_topic"), "off_topic")
    severity = F.when(c("label") == "unsupported", "high").when(c("label") == "partial", "low").otherwise("medium")
    each = j.withColumn("rule", rule).where("rule IS NOT NULL").select("doc_id", "rule", severity.alias("severity"), "para_id", "start_pos", "end_pos", F.array("ref_id").alias("refs"), F.lit(1).cast("bigint").alias("n_claims"))
    lost = j.where("rationale = 'no source'").groupBy("doc_id").agg(F.sort_array(F.collect_set("ref_id")).alias("refs"), F.countDistinct("para_id", "start_pos", "end_pos").alias("n_claims"))
    kinds = {f.name: f.dataType for f in each.schema}
    return each.unionByName(lost.select("doc_id", F.lit("no_source").alias("rule"), F.lit("low").alias("severity"), *(F.lit(None).cast(kinds[x]).alias(x) for x in ("para_id", "start_pos", "end_pos")), "refs", "n_claims"))


def classified(rows: DataFrame, provider: Provider, task: str, allowed: list[str], *, quoted: bool = False, batch: int = 8) -> DataFrame:
    """id, label, quote: a provider's labels for texts, kept where they are among `allowed` and, where `quoted`, the quote stands in
    the text; all else is null. rows: id, text. Equal texts are asked once."""
    def ask(batches):
        for some in batches:
            texts = some.column(0).to_pylist()
            got = [a or {} for k in range(0, len(texts), batch) for a in provider([{"task": task, "text": t} for t in texts[k : k + batch]])]
            fine = [a.get("label") in allowed and (not quoted or bool(a.get("quote")) and locate_spliced(a["quote"], t) is not None) for a, t in zip(got, texts)]
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array([a["label"] if ok else None for a, ok in zip(got, fine)], pa.string()), pa.array([a.get("quote") if ok else None for a, ok in zip(got, fine)], pa.string())], ["text", "label", "quote"])

    told = cut(rows.where("text IS NOT NULL").select("text").distinct().mapInArrow(ask, "text string, label string, quote string"))
    return rows.join(told, "text", "left").select("id", "label", "quote")

