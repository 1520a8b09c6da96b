"""Wordings that a caller of llm.headings may give beside a list: what no likeness of letters leads to."""

# Other ways to write each entry of the heading list, by its English name.
OTHER_WORDINGS = {
    "Introduction": "intro; introd; opening remarks; getting started; einführung; 绪论; 前言; 导论; preliminary remarks; background",
    "Motivation": "rationale for the study; why this matters; 选题动机; 研究动因; why we did this study",
    "Research Questions": "questions addressed; what we ask; 待答问题; research question; questions we ask",
    "Contributions": "our contribution; what this paper adds; 本文贡献; contribution; key contributions",
    "Related Work": "rel wk; rel work; prior art; prior work; earlier studies; earlier work; previous research; previous work; previous studies; 前人研究; 相关研究; related research; related studies",
    "Literature Review": "lit review; lit rev; review of published studies; survey of the literature; 文献回顾; 研究综述; review of the literature; literature survey",
    "Theoretical Framework": "theory and concepts; conceptual underpinnings; 理论框架; theor framework; conceptual framework; theory",
    "Methodology": "meth; methodol; method; methods; methods used; how the study was done; 方法论; 方法; how we did it; our approach; approach; 研究设计",
    "Study Area": "field site description; where we worked; 研究区概况; 研究区; study site; field site",
    "Data Collection": "data coll; gathering the data; how data were obtained; 资料收集; 数据收集; collection of data; data acquisition",
    "Model Architecture": "model arch; how the model is built; structure of the network; 网络结构; 模型架构; network architecture; network structure",
    "Statistical Analysis": "stats anal; stat analysis; statistics used; statistical treatment of the data; 统计处理; 统计分析; statistical methods",
    "Sampling Procedure": "how samples were drawn; selection of samples; 样本选取; 抽样; sampling; sampling proc; sample selection",
    "Implementation Details": "impl details; notes on the implementation; implementation specifics; 具体实现; implementation",
    "Experimental Setup": "exp setup; expt set up; setting up the trials; configuration of the experiments; 实验环境; 实验设计; experiment setup; experimental design; experimental configuration",
    "Results": "reslts; findings; outcomes; what we found; 研究发现; 研究结果; 结果; main findings",
    "Ablation Study": "ablations; ablation; removing components one by one; 消融分析; 消融研究; ablation experiments",
    "Baselines": "systems compared; reference systems; 对比方法; baseline; baseline methods; compared systems",
    "Evaluation Metrics": "eval metrics; performance measures; how we score; 评估标准; 评估指标; metrics; evaluation measures",
    "Case Study": "a worked example; an illustrative case; 个案分析; 案例分析; case studies; worked example; illustrative case",
    "Discussion": "disc; discuss; interpretation of findings; interpretation of the findings; what the findings mean; 结果讨论; 讨论与分析",
    "Limitations": "lims; limits; shortcomings; weaknesses of this study; 不足之处; 研究局限; 研究不足; weaknesses",
    "Threats to Validity": "what could undermine validity; validity concerns; 有效性威胁; validity threats; threats",
    "Ethical Considerations": "ethical consid; research ethics; ethics statement; 伦理声明; 研究伦理; ethics; ethical issues",
    "Conclusion": "conc; concl; conclusions; closing remarks; summing up; concluding thoughts; concluding remarks; 结束语; 结语; 总结; summary and conclusions",
    "Future Work": "fut work; outlook; next steps; directions for further research; 研究展望; 展望; future research; future directions; further research",
    "Practical Implications": "pract implications; implications for practice; what practitioners can take away; 实践意义; 实践启示与建议; implications",
}
# Headings of parts that the list doesn't hold.
NO_ENTRY = (
    "acknowledgments; acknowledgements; danksagung; remerciements; agradecimientos; 致谢; funding; funding statement; keywords; 关键词; "
    "glossary; nomenclature; abbreviations; index of places; index; appendix; 附录; anhang; annexe; apéndice; data availability; "
    "conflict of interest; conflicts of interest; competing interests; author contributions; supplementary tables; supplementary material; "
    "references; bibliography; 参考文献; untitled; todo; tbd; abstract; 摘要; table of contents; contents; section; chapter; preface; 目录"
)
# Ways to write the canonical sections.
SECTIONS = {
    "intro": "intro; introd; introduction; intro section; 引言; 绪论; 前言; einleitung; introducción",
    "related": "related; relatd; related work; rel work; rel wk; related works; 相关; 相关工作; 文献综述; literature; prior work; lit review",
    "method": "method; methods; meth; methd; methodology; 方法; 研究方法; methodik; mthd",
    "experiment": "experiment; experiments; exp; expt; expts; experimnt; experimental; 实验; 实验结果; results; evaluation; eval",
    "discussion": "discussion; disc; discusion; discuss; discussions; 讨论; diskussion",
    "conclusion": "conclusion; conclusions; concl; conc; conclsion; 结论; 结语; summary; closing",
    "other": "other; othr; others; misc other; misc; miscellaneous; 其他; 其它; sonstiges; otros; autre; etc",
}
# What is typed where nothing is meant.
NO_SECTION = "x; ok; yes; no; to check; see above; tbd; needs title; draft; todo; n a; none; null; unknown; check; check this; pending; see below; title; na"


def split(some: str) -> list[str]:
    return [x.strip() for x in some.split(";")]


HEADINGS = {name: split(some) for name, some in OTHER_WORDINGS.items()} | {"none": split(NO_ENTRY)}
LABELS = {name: split(some) for name, some in SECTIONS.items()} | {"none": split(NO_SECTION)}
