import os
import random

import pytest
from pyspark.sql import functions as F

from quire.llm import headings, leakage, lookalike, reading, sentences, tokens, transducer, wordings, works

VOCABULARY = f"{tokens.VOCABULARY}/byte_bpe_50k.tiktoken"
needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# 1

CATALOG = [("H01", "intro", "Introduction", ["引言", "Einleitung"]), ("H05", "related", "Related Work", ["相关工作"]), ("H16", "experiment", "Results", None), ("H21", "discussion", "Discussion", ["Discussion des résultats"])]
SECTION = "section_id string, title string, canonical string, target string, field_name string"


def catalog(spark):
    return spark.createDataFrame(CATALOG, "entry_code string, canonical string, name string, other_names array<string>")


def mapped(sections, entries):
    return headings.map_headings(sections, entries, headings=wordings.HEADINGS, labels=wordings.LABELS)


def test_headings(spark):
    typed = {"1. Introduction": "H01", "Ｒesults (north only)": "H16", "R e l a t e d   W o r k": "H05", "Reslts": "H16", "Discussion des résultats": "H21", "2 引　言": "H01", "Rеlаtеd Wоrk": "H05", "What We Found": "H16", "Resultant Forces on Bridge Decks": "none", "Funding": "none", "3.2": "none", "D1scussion": "H21", "Introduction and " + "x " * 5000: "H01", "Intro​duction": "H01", "Author Contributions": "none"}
    data = [(f"s{i}", t, None, "x", "y") for i, t in enumerate(typed)] + [("c", None, "methd", "", ""), ("c2", " ", "see above", "", ""), ("c2", " ", "see above", "", ""), (None, "Results", None, "", "")]
    got = {(r.section_id, r.field_name): r.target for r in mapped(spark.createDataFrame(data, SECTION), catalog(spark)).collect()}
    for i, (t, want) in enumerate(typed.items()):
        assert got[f"s{i}", "title"] == want, t
    assert got["c", "canonical"] == "method" and got["c2", "canonical"] == "none" and got[None, "title"] == "H16"
    assert len(got) == len(typed) + 3
    none = spark.createDataFrame([], SECTION)
    assert mapped(none, catalog(spark)).count() == 0
    assert {r.target for r in mapped(spark.createDataFrame(data, SECTION), catalog(spark).where("false")).where("field_name = 'title'").collect()} == {"none"}
    found = mapped(spark.createDataFrame(data, SECTION), catalog(spark))
    assert ("canonical", "see above", 1) in rows(headings.unmatched(found, spark.createDataFrame(data, SECTION)))


def test_likeness_alone():
    """Without other wordings, and against a plain score of every wording."""
    title, label = headings.matchers(CATALOG, {}, {})
    for typed, want in {"Reslts": "H16", "What We Found": "none", "Ｒeltaed Wrok": "H05", "Reslts (" + "as was told at length in an earlier report " * 5 + ")": "H16", "word " * 100_000: "none", "Introdction: " + "of many things " * 20: "H01"}.items():
        assert title.match(typed) == want, typed[:40]
    assert label.match("relatd") == "related" and label.match("x") == "none"

    def plainly(m, words):
        own, joined, best = [w for w in words if w not in headings.FILLER] or words, "".join(words), 0.0
        for _, tokens_, name in m.names:
            n = max(len(joined), len(name))
            d = headings.distance(joined, name, n)
            left, gain = list(own), 0.0
            for t in tokens_:
                if left and (x := max((headings.likeness(w, t), w) for w in left))[0] >= headings.LIKE:
                    gain += x[0] * len(t)
                    left.remove(x[1])
            best = max(best, 1 - d / n if d <= max(1, n * 0.3) else 0.0, gain / (sum(map(len, tokens_)) + 0.7 * sum(map(len, left))))
        return best

    rng = random.Random(3)
    names = [n for _, _, n, _ in CATALOG]
    for _ in range(400):
        letters = list(rng.choice(names) + rng.choice(["", " of it", " results"]))
        for _ in range(rng.randrange(5)):
            letters[rng.randrange(len(letters))] = rng.choice("aeirst ")
        words = headings.words_of("".join(letters))
        if words and (want := plainly(title, words)) >= title.least:
            assert abs(title.similar(words)[0] - want) < 1e-9, words


def test_distance():
    def slow(a, b):
        d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i * j}
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (x != y), *([d[i - 2, j - 2] + 1] if i > 1 < j and x == b[j - 2] and y == a[i - 2] else []))
        return d[len(a), len(b)]

    rng = random.Random(1)
    for _ in range(500):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 7))) for _ in range(2))
        assert headings.distance(a, b, 3) == min(slow(a, b), 4)


# 2

REFS = "ref_id string, raw string, title string, authors array<string>, year int, doi string, record_id string, rep string"
RECORDS = "record_id bigint, source string, answered boolean, title string, main_title string, authors array<string>, year int, alt_year int, venue string, doi string, arxiv_id string, confidence double"


def test_works(spark):
    refs = [
        ("r1", "A. Lee and B. Kim. Sparse noise exposure in Talvik: a study of 12 boats. Some Journal, 3(2):1-9, 2001.", None, None, None, None, "x", "y"),
        ("r2", "Lee A, Kim B (2001) Sparse noise expsoure in Talvik. J. 3:1-9", "wrong", ["Z"], 1900, "10.1/bad", "", ""),
        ("r3", "Lee, A., & Kim, B. (2003). Sparse noise exposure in Talvik, Part II. Some Journal, 4, 1-9.", None, None, 2003, None, "", ""),
        ("r4", "C. Other. Sparse noise exposure in Talvik. Else, 1:1-2, 2001.", None, None, None, None, "", ""),
        ("r5", None, "Sparse Noise Exposure in Talvik", ["Lee, A."], 2001, None, "", ""),
        ("r6", None, None, None, None, None, "", ""), ("r7", "", "", [], None, "", "", ""), ("r8", "x" * 50_000, None, None, None, None, "", ""), (None, "Lee A (2001) Sparse noise exposure in Talvik. J.", None, None, None, None, "", ""),
        ("r9", "郗翎黎, 禤澜垚. 棠嵘坞同伴反馈的稀疏表示研究[J]. 文本核查通讯, 2018, 50(11): 649-667.", None, None, None, None, "", ""),
    ]
    records = [
        (1, "a", True, "Sparse noise exposure in Talvik", None, ["A. Lee", "B. Kim"], 2001, None, None, None, None, 0.5), (2, "b", True, "SPARSE NOISE EXPOSURE IN TALVIK - a study of 12 boats", "Sparse noise exposure in Talvik", ["Lee, A.", "Kim, B."], 2000, None, None, None, "pb:1", 0.5),
        (3, "a", True, "Correction to: Sparse noise exposure in Talvik", None, ["A. Lee", "B. Kim"], 2001, None, None, None, None, 0.5), (4, "a", False, None, None, None, None, None, None, None, None, 0.5), (5, "a", True, None, None, None, None, None, None, "10.1/bad", None, 0.5),
        (6, "a", True, "棠嵘坞同伴反馈的稀疏表示研究", None, ["郗翎黎"], 2018, None, None, None, None, 0.5), (1, "a", True, "Sparse noise exposure in Talvik", None, ["A. Lee", "B. Kim"], 2001, None, None, None, None, 0.5),
    ]
    a, b = spark.createDataFrame(refs, REFS), spark.createDataFrame(records, RECORDS)
    got = works.match_works(a, b)
    assert rows(got.select("ref_id", "record_id")) == sorted([("r1", 1), ("r1", 2), ("r2", 1), ("r2", 2), ("r5", 1), ("r5", 2), ("r9", 6)], key=str)
    assert all(0 <= r.confidence <= 1 for r in got.collect())
    assert works.match_works(a.where("false"), b).count() == 0 and works.match_works(a, b.where("false")).count() == 0


def test_hot_work(spark):
    """A work that a third of all references cite, split into many blocks."""
    refs = [(f"r{i}", f"Lee A, Kim B (2001) Sparse noise exposure in Talvik. J. {i}:1-9", None, None, None, None, "", "") for i in range(60)] + [(f"o{i}", f"Nam{chr(97 + i % 26)}x C (19{50 + i % 40}) Robust river ice near Place{chr(97 + i % 26)}{chr(97 + i // 26)}. J. 1:1-9", None, None, None, None, "", "") for i in range(120)]
    records = [(1, "a", True, "Sparse noise exposure in Talvik", None, ["A. Lee", "B. Kim"], 2001, None, None, None, None, 0.5)]
    got = works.match_works(spark.createDataFrame(refs, REFS), spark.createDataFrame(records, RECORDS), hot=10)
    assert {r.ref_id for r in got.collect()} == {f"r{i}" for i in range(60)}


def shuffle_files(spark) -> int:
    return sum(f.split("/")[-1].startswith("shuffle_") for f in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n"))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_works_disk(spark, monkeypatch):
    """What the passes shuffle goes as each ends (all of it stayed before), and passes and slices change no pair."""
    from quire.session import Stored

    n = shuffle_files(spark)
    stored = Stored(spark.range(1000).repartition(3, "id").groupBy("id").count())
    assert stored.df.count() == 1000
    stored.drop()
    refs, records = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("reference_entries", "candidate_records"))
    whole = works.match_works(refs, records)
    assert shuffle_files(spark) - n < 30
    want = {tuple(r) for r in whole.collect()}
    monkeypatch.setattr(works, "PASS", 3000)
    monkeypatch.setattr(works, "SLICE", 300)
    assert {tuple(r) for r in works.match_works(refs, records).collect()} == want and len(want) > 1000


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_recall(spark):
    """Of the references of every twentieth id, against all records by the exact comparison alone, nine in ten pairs or more come out."""
    import json

    refs, records = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("reference_entries", "candidate_records"))
    asked = refs.where(F.pmod(F.xxhash64("ref_id"), F.lit(20)) == 0)
    a, b = ({r.id: json.loads(r.profile) for r in x.collect()} for x in works.profiles_of(asked, records))
    want = {(i, k) for i, p in a.items() for k, q in b.items() if works.same_work(p, q)}
    got = {(r.ref_id, r.record_id) for r in works.match_works(refs, records).collect()}
    assert len(want) > 20 and len(want & got) >= 0.9 * len(want) and {g for g in got if g[0] in a} <= want


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_training(spark):
    """Trained vectors lead to pairs that start vectors miss, from the same number of tables."""
    refs, records = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("reference_entries", "candidate_records"))
    plain, trained = ({(r.ref_id, r.record_id) for r in works.match_works(refs, records, learn=x, tables=2, flips=0).collect()} for x in (0.0, 1.0))
    assert len(trained) > 1.01 * len(plain) and len(trained & plain) > 0.99 * len(plain)


def test_surnames():
    assert len(works.surnames([f"Family{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)])) == 60


def test_parsing():
    for raw, authors, title in (
        ("A. Lee and B. Kim. A title: sub. Venue, 1, 2001.", ["kim", "lee"], "A title: sub"), ("Lee, A., & Kim, B. (2001). A title. Venue, 4.", ["kim", "lee"], "A title"), ("A. Lee et al., “A title,” Venue, 2001.", ["lee"], "A title"),
        ("LEE A, KIM B, et al. A title[J]. Venue, 2001.", ["kim", "lee"], "A title"), ("王一、李二（2001）。题目。《刊》，第1卷。", ["李二", "王一"], "题目"), ("王一, 李二. 题目[J]. 刊, 2001.", ["李二", "王一"], "题目"),
    ):
        names, told, _ = works.parse_line(raw)
        assert works.surnames([names]) == authors and told == title, raw
    assert works.title_of("Erratum: <i>A</i> b &amp; c, Part Two: sub 3") == ("A b & c", "sub 3", "2", "k")
    assert works.title_of("A b II") == ("A b", "", "2", "")
    assert works.calibrate([]) == [i / 40 for i in range(41)] and sorted(c := works.calibrate([(3, 10, 9), (5, 10, 1), (30, 10, 10)])) == c


# 4


def texts_of(model, text):
    return [text[a:b] for a, b in model.spans(text)]


def test_sentences(spark):
    model = sentences.Model()
    for text, want in {
        "Dr. P. M. Lee came. He left.": ["Dr. P. M. Lee came.", "He left."], "It is 3.5 m, cf. Fig. 2. Then x.": ["It is 3.5 m, cf. Fig. 2.", "Then x."], "He said “It failed. We stopped.” Then more.": ["He said “It failed. We stopped.”", "Then more."],
        "Ended.[3] Next (a. B) one": ["Ended.[3]", "Next (a. B) one"], "先做。后做！「停。走。」と言った。": ["先做。", "后做！", "「停。走。」と言った。"], "One line\nbreaks here. Next.": ["One line\nbreaks here.", "Next."], "": [], " \n": [], "No stop": ["No stop"], "Done.\\cite{a,b} Next.": ["Done.\\cite{a,b}", "Next."],
        "他问：“可靠吗？谁查过？”其中有。": ["他问：“可靠吗？谁查过？”", "其中有。"], "“停。走！”他这样说。": ["“停。走！”他这样说。"], "Es war am 4. Mai so. Dann.": ["Es war am 4. Mai so.", "Dann."],
    }.items():
        assert texts_of(model, text) == want
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice(" .!?\n“”()。,aB1é中ไ«»…") for _ in range(40))
        spans = model.spans(text)
        covered = [i for a, b in spans for i in range(a, b)]
        assert covered == sorted(set(covered)) and all(text[i].isspace() for i in set(range(len(text))) - set(covered))
        assert all(text[a:b] == text[a:b].strip() for a, b in spans)
    parts = ["การศึกษานี้ดี", "นักวิจัยไปที่บ้าน", "ทีมสำรวจพบ 12 ชิ้น", "แบบจำลองที่สองใช้ได้"]
    data = [(f"p{i}", " ".join(rng.sample(parts, rng.randint(1, 4))), 7) for i in range(200)] + [("n", None, 1), ("e", "", 1), ("p0", None, 2), ("long", "A word came. " * 20_000, 1), ("h", "Heading", 1)]
    df = spark.createDataFrame(data, "para_id string, text string, spans int")
    got = sentences.split_sentences(df, spark.createDataFrame([("h",)], "para_id string"))
    texts = {p: t for p, t, _ in data if t}
    found: dict = {}
    for r in got.collect():
        found.setdefault(r.para_id, []).append(texts[r.para_id][r.start_pos : r.end_pos])
    right = sum(set(found[p]) <= set(parts) for p in texts if p.startswith("p"))
    assert right >= 190 and len(found["long"]) == 20_000 and "h" not in found and "n" not in found
    assert sentences.split_sentences(df.where("false")).count() == 0


# 5


def test_lookalikes(spark):
    same = [("é", "é"), ("Ｗork", "Work"), ("Wоrk", "Work"), ("a b", "a b"), ("a​b", "ab"), ("ﬁx", "fix"), ("⼈", "人"), ("a‑b", "a-b"), ("가", "가"), ("e​́", "é")]
    for a, b in same:
        assert lookalike.canonical(a) == lookalike.canonical(b)
    for a, b in [("a", "á"), ("A", "a"), ("x²", "x2"), ("…", "..."), ("a b", "a  b"), ("1", "l"), ("a b", "a\nb"), ("“", '"')]:
        assert lookalike.canonical(a) != lookalike.canonical(b)
    rng = random.Random(2)
    pool = "ab é̈éＡｂ​­ 中⼈оА1²ำไ가ᅡ"
    for _ in range(500):
        t = "".join(rng.choice(pool) for _ in range(12))
        c = lookalike.canonical(t)
        assert lookalike.canonical(c) == c
    data = [("raw", f"i{n}", t, "z") for n, t in enumerate(["Work", "Ｗork", "Work", "work", "", None, "Wоrk"])] + [("raw", None, "Work", "z"), ("text", "i9", "Work", "z"), ("raw", "i1", "Ｗork", "z"), ("raw", "out", "Wo​rk", "z")]
    df = spark.createDataFrame(data, "field_name string, id string, text string, form string")
    got = rows(lookalike.same_look(df, spark.createDataFrame([("raw", "out")], "field_name string, id string"), block=1))
    assert got == [("raw", "i0", "i1"), ("raw", "i0", "i6"), ("raw", "i1", "i2"), ("raw", "i1", "i6"), ("raw", "i2", "i6")]
    assert lookalike.same_look(df.where("false")).count() == 0
    assert [r.text for r in lookalike.canonical_text(df.where("id IN ('i1', 'i5')"), "text").orderBy(F.col("text").isNull()).collect()] == ["Work", "Work", None]
    hot = spark.createDataFrame([("raw", f"h{i:03}", "W" if i % 3 else "Ｗ", "") for i in range(90)], "field_name string, id string, text string, form string")
    assert lookalike.same_look(hot, block=7).count() == 30 * 60
    for some, out in ((df, spark.createDataFrame([("raw", "out")], "field_name string, id string")), (hot, None)):
        links: dict = {}
        for f, a, b in rows(lookalike.same_look(some, out)):
            links[f, a] = links.get((f, a), 0) + 1
            links[f, b] = links.get((f, b), 0) + 1
        assert {(r.field_name, r.id): r.n_links for r in lookalike.look_classes(some, out).collect()} == links
    assert lookalike.look_classes(df.where("false")).count() == 0
    assert lookalike.canonical("ꓮꓐ Ꭺ Ⲟ") == "AB A O"


# 6


def test_transducer():
    rng = random.Random(1)
    for n in (0, 1, 5, 400):
        words = sorted({bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 6))) for _ in range(n)})
        items = [(w, [rng.randint(0, 9) for _ in range(rng.randint(1, 3))]) for w in words]
        net, told = transducer.Transducer(transducer.compile_words(items)), dict(items)
        asked = [bytes(rng.choice(b"abcd") for _ in range(rng.randint(0, 7))) for _ in range(500)] + words
        for w, r in zip(asked, net.rank(asked)):
            assert (list(net.output(r)) == told[w]) if r >= 0 else w not in told
    shared = transducer.Transducer(transducer.compile_words([(a + b"ing", [1]) for a in (b"go", b"run", b"sing")]))
    assert len(shared.keys) < sum(len(a) + 3 for a in ("go", "run", "sing"))


@needs_vocabulary
def test_tokens(spark):
    import tiktoken

    ranks = tokens.ranks_of(VOCABULARY)
    own = tiktoken.Encoding("test", pat_str=tokens.PATTERN.pattern, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    texts = ["", None, " ", "a", "<|endoftext|> it's", "x" * 3000, " \n\n  a\t", "".join(chr(rng.choice([*range(32, 127), 0x4E2D, 0xE9, 0x1F600, 0x200B, 0xA0, 10])) for _ in range(5000)), "word " * 300_000, *["some words that come often, " * rng.randint(1, 4) for _ in range(50)]]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(0, "", "clash")], "doc_id bigint, text string, ids string")
    got = tokens.encode_corpus(df, words=20)
    assert got.schema.simpleString() == "struct<doc_id:bigint,ids:array<int>>"
    for r in got.collect():
        assert r.ids == own.encode_ordinary(texts[r.doc_id] or "")
    assert got.count() == len(texts) + 1 and tokens.encode_corpus(df.where("false")).count() == 0
    for w in (b"hello", b" lowercase", "中文".encode(), b"zqxj" * 5):
        assert tokens.merge(w, ranks) == own._encode_single_piece(w)


# 7


def test_leaks(spark):
    rng = random.Random(4)
    names = ["Torku", "Welbo", "Sarn", "Mivik", "Dorla", "Kestu", "Pranik", "Ulvo"]
    item = lambda: " ".join(f"In {rng.randint(1900, 2020)}, {rng.choice(names)}{rng.randint(10, 99)} moved {rng.randint(100, 999)} labelled trays from {rng.choice(names)}heim{rng.randint(10, 99)} to the northern store before anyone signed for them." for _ in range(3))
    items = [(i, item(), "q") for i in range(40)]
    fill = lambda: " ".join(rng.choice("the of river people often walk some water small house by night and day with care".split()) for _ in range(80))
    docs, want = [], set()
    for n in range(120):
        i, passage, _ = rng.choice(items)
        words = passage.split()
        kind = n % 5
        if kind == 0:
            body = passage.upper()
        elif kind == 1:
            body = " ".join(words[: int(len(words) * 0.7)]).replace("o", "о").replace(" the ", "\nthe ")
        elif kind == 2:
            body = " ".join(w if rng.random() > 0.05 else "xyz" for w in words)
        else:
            body = " ".join(words[: len(words) // 5]) if kind == 3 else item()
        docs.append((n, f"{fill()} {body} {fill()}", "item"))
        if kind < 3:
            want.add((n, i))
    docs += [(200, None, ""), (201, "", ""), (202, " ".join([fill() for _ in range(300)]), ""), (0, docs[0][1], "item")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string")
    e = spark.createDataFrame([*items, (90, None, "q"), (91, "", "q"), (0, items[0][1], "again")], "item_id int, passage string, doc_id string")
    got = {(r.doc_id, r.item_id) for r in leakage.leaks(d, e).collect()}
    assert len(got & want) >= 0.97 * len(want) and got <= want
    assert {(r.doc_id, r.item_id) for r in leakage.leaks(d, e, block=9).collect()} == got
    other = {(r.doc_id, r.item_id) for r in leakage.leaks(d, e, mode="template").collect()}
    assert other and not other & got
    assert leakage.leaks(d.where("false"), e).count() == leakage.leaks(d, e.where("false")).count() == 0


def test_leak_places():
    """A stretch is found wherever it stands in its item and its document, and whatever stands before it."""
    rng = random.Random(6)
    long = [f"w{rng.randrange(3000)}" for _ in range(15_000)]
    net = leakage.Items([(1, " ".join(long))])
    part = " ".join(long[6000:])
    for texts in ([part], ["other words first", part], [part, "and after"]):
        got = net.search(list(range(len(texts))), texts, 0.1, 0.46, 0.82, "held")
        assert got == [(texts.index(part), 0)]
    words = "the old survey of river ice near a small town asked every second house how long the winter roads stayed closed and who kept them open".split()
    items = [(i, " ".join(rng.choice(words) if rng.random() < 0.8 else f"Nam{rng.randrange(10**6)}" for _ in range(120))) for i in range(30)]
    net = leakage.Items(items)
    for every in (6, 7, 8):  # of half a passage each sixth word changed, and more
        found = 0
        for i, passage in items:
            some = passage.split()[: 66]
            some[every - 1 :: every] = ["changed"] * len(some[every - 1 :: every])
            found += (0, i) in net.search([0], [" ".join(some)], 0.1, 0.46, 0.82 if every > 6 else 0.8, "held")
        assert found >= 29, every
    # whatever the bounds drop the alignment would refuse
    for _ in range(300):
        i, passage = rng.choice(items)
        some = [w if rng.random() < rng.choice((0.5, 0.9)) else "x" for w in passage.split()[rng.randrange(60) :]]
        lit = net.code(some) >> 32
        got, same, slots = net.stretch(i, lit, -80, 80)
        if got >= 0.46 and same >= 0.82 and slots >= leakage.SLOTS:
            assert net.possible(i, lit, -80, 80, 0.46, 0.82)


def test_leak_templates(spark):
    say = lambda name, n, unit: f"In the first trial {name} carried {n} {unit} of wet sand across the yard and then rested for an hour before anyone weighed the load again."
    items = spark.createDataFrame([("a", say("Torku", 12, "kg"))], "item_id string, passage string")
    docs = spark.createDataFrame([("same", say("Torku", 12, "kg")), ("filled", say("Welbo", 77, "lbs")), ("none", "In the first trial nothing was carried.")], "doc_id string, text string")
    assert rows(leakage.leaks(docs, items)) == [("same", "a")]
    assert rows(leakage.leaks(docs, items, mode="template")) == [("filled", "a")]


# 8


def test_reading(spark):
    rng = random.Random(5)
    vocabulary = [[f"{'abcd'[k]}{c}{v}{n}" for c in "bcdfg" for v in "aeiou" for n in "mnrst"] for k in range(4)]
    docs, labels, truth = [], [], {}
    for n in range(400):
        k = n % 4
        words = [rng.choice(vocabulary[k if rng.random() < 0.8 else rng.randrange(4)]) for _ in range(80)]
        docs.append((n, ". ".join(" ".join(words[i : i + 4 + 3 * k]) for i in range(0, 80, 4 + 3 * k)), 1))
        truth[n] = k + 1
        if n % 5 == 0:
            labels += [(n, k + 1, "a", "t"), (n, k + 1 if rng.random() < 0.9 else 1 + (k + 1) % 4, "b", "t")]
    docs += [(900, None, 1), (901, " ", 1), (902, "12.5, 33 | 9", 1), (903, "word", 1), (904, "中文句子。" * 20_000, 1)]
    labels += [(900, 1, "a", "t"), (1, None, "a", "t"), (2, 9, "a", "t"), (None, 2, "a", "t")]
    d, l = spark.createDataFrame(docs, "doc_id bigint, text string, level int"), spark.createDataFrame(labels, "doc_id bigint, level int, rater string, text string")
    got = {r.doc_id: r.level for r in reading.reading_levels(d, l).collect()}
    assert sum(got[n] == k for n, k in truth.items()) >= 0.95 * len(truth)
    assert set(got) == {*truth, 903, 904} and set(got.values()) <= {1, 2, 3, 4}
    assert {r.level for r in reading.reading_levels(d, l.where("false")).collect()} == {None}
    assert reading.reading_levels(d.where("false"), l).count() == 0
    assert reading.words_of("Don't 中文字 x1") == ["don't", "中文", "文字", "x"]


def test_extra_columns(spark):
    """Operators take the columns they name and leave others alone."""
    d = spark.createDataFrame([(1, "Some text here.", "a", 2)], "doc_id bigint, text string, word string, n int")
    assert reading.reading_levels(d, spark.createDataFrame([(1, 2, 3)], "doc_id bigint, level int, df int")).count() == 1
    assert d.select(F.col("n")).first().n == 2
