"""Task registry: reader, label set, metrics and languages per task, and the two job plans."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import multi_hot
from ..operators.layouts import model_family
from . import bundles

# --- fixed values: language codes and ids, marker ids, label sets, task settings ----------
LANGUAGE_TOKENS = {"[java]": 40000, "[sunda]": 40001, "[indonesia]": 40002, "<mask>": 40003}
LANGUAGE_ALIASES = {
    "[javanese]": "[java]", "[sundanese]": "[sunda]", "[indonesian]": "[indonesia]",
}
LANGUAGE_CODES = [
    "ar_AR", "cs_CZ", "de_DE", "en_XX", "es_XX", "et_EE", "fi_FI", "fr_XX", "gu_IN", "hi_IN", "it_IT", "ja_XX",
    "kk_KZ", "ko_KR", "lt_LT", "lv_LV", "my_MM", "ne_NP", "nl_XX", "ro_RO", "ru_RU", "si_LK", "tr_TR", "vi_VN",
    "zh_CN", "af_ZA", "az_AZ", "bn_IN", "fa_IR", "he_IL", "hr_HR", "id_ID", "ka_GE", "km_KH", "mk_MK", "ml_IN",
    "mn_MN", "mr_IN", "pl_PL", "ps_AF", "pt_XX", "sv_SE", "sw_KE", "ta_IN", "te_IN", "th_TH", "tl_XX", "uk_UA",
    "ur_PK", "xh_ZA", "gl_ES", "sl_SI", "su_SU", "jv_JV", "<speaker_1>", "<speaker_2>",
]
# separator, speaker 1, speaker 2
MARKERS = {
    "bart": (4, 5, 6), "gpt2": (4, 5, 6), "transformer": (4, 5, 6),
    "mbart": (2, 250055, 250056), "mt5": (3, 4, 5),
}
LABELS = {
    "aspect_extraction": ["I-SENTIMENT", "O", "I-ASPECT", "B-SENTIMENT", "B-ASPECT"],
    "ner_grit": ["I-PERSON", "B-ORGANISATION", "I-ORGANISATION", "B-PLACE", "I-PLACE", "O", "B-PERSON"],
    "ner_prosa": [
        "I-PPL", "B-EVT", "B-PLC", "I-IND", "B-IND", "B-FNB", "I-EVT", "B-PPL", "I-PLC", "O", "I-FNB",
    ],
    "pos_idn": [
        "B-PR", "B-CD", "I-PR", "B-SYM", "B-JJ", "B-DT", "I-UH", "I-NND", "B-SC", "I-WH", "I-IN", "I-NNP", "I-VB",
        "B-IN", "B-NND", "I-CD", "I-JJ", "I-X", "B-OD", "B-RP", "B-RB", "B-NNP", "I-RB", "I-Z", "B-CC", "B-NEG",
        "B-VB", "B-NN", "B-MD", "B-UH", "I-NN", "B-PRP", "I-SC", "B-Z", "I-PRP", "I-OD", "I-SYM", "B-WH", "B-FW",
        "I-CC", "B-X",
    ],
    "pos_prosa": [
        "B-PPO", "B-KUA", "B-ADV", "B-PRN", "B-VBI", "B-PAR", "B-VBP", "B-NNP", "B-UNS", "B-VBT", "B-VBL", "B-NNO",
        "B-ADJ", "B-PRR", "B-PRK", "B-CCN", "B-$$$", "B-ADK", "B-ART", "B-CSN", "B-NUM", "B-SYM", "B-INT", "B-NEG",
        "B-PRI", "B-VBE",
    ],
    "emotion": ["sadness", "anger", "love", "fear", "happy"],
    "entailment": ["NotEntail", "Entail_or_Paraphrase"],
    "document_sentiment": ["positive", "neutral", "negative"],
    "keyword_extraction": ["O", "B", "I"],
    "qa_factoid": ["O", "B", "I"],
    "absa_hotel": ["neg", "neut", "pos", "neg_pos"],
    "absa_car": ["negative", "neutral", "positive"],
    "news_category": [
        "permasalahan pada bank besar domestik",
        "pertumbuhan ekonomi domestik yang terbatas",
        "volatilitas harga komoditas utama dunia",
        "frekuensi kenaikan fed fund rate (ffr) yang melebihi ekspektasi",
        "perubahan kebijakan dan/atau regulasi pada institusi keuangan",
        "isu politik domestik",
        "permasalahan pada bank besar international",
        "perubahan kebijakan pemerintah yang berkaitan dengan fiskal",
        "pertumbuhan ekonomi global yang terbatas",
        "kebijakan pemerintah yang bersifat sektoral",
        "isu politik dan ekonomi luar negeri",
        "kenaikan harga volatile food",
        "tidak berisiko",
        "pergerakan harga minyak mentah dunia",
        "force majeure yang memengaruhi operasional sistem keuangan",
        "kenaikan administered price",
    ],
}
ASPECTS = {
    "absa_hotel": [
        "ac", "air_panas", "bau", "general", "kebersihan", "linen", "service", "sunrise_meal", "tv", "wifi",
    ],
    "absa_car": ["fuel", "machine", "others", "part", "price", "service"],
}
# task: folder and file stem suffix, source language, target language
TRANSLATION = {
    "mt-javnrf-inzntv": ("MT_JAVNRF_INZNTV", ("[java]", "jv_JV"), ("[indonesia]", "id_ID")),
    "mt-sunibs-inzntv": ("MT_SUNIBS_INZNTV", ("[sunda]", "su_SU"), ("[indonesia]", "id_ID")),
    "mt-enkjv-inzntv": ("MT_ENGKJV_INZNTV", ("[english]", "en_XX"), ("[indonesia]", "id_ID")),
    "mt-ted-multi": ("MT_TED_MULTI", ("[english]", "en_XX"), ("[indonesia]", "id_ID")),
    "mt-imd-news": ("MT_IMD_NEWS", ("[english]", "en_XX"), ("[indonesia]", "id_ID")),
    "mt-imd-religion": ("MT_IMD_RELIGION", ("[english]", "en_XX"), ("[indonesia]", "id_ID")),
}
# task: reader, metric bundle, selection metric, folder, train, valid and test file
MONOLINGUAL = {
    "indosum": ("parallel", "generation", "SacreBLEU", "indosum", ("train.json", "dev.json", "test.json")),
    "xpersona": (
        "dialogue", "generation", "SacreBLEU", "xpersona",
        (
            "Id_persona_train_corrected.json", "Id_persona_split_valid_human_annotated.json",
            "Id_persona_split_test_human_annotated.json",
        ),
    ),
    "liputan6_canonical": (
        "parallel", "generation", "BLEU", "liputan6",
        ("canonical_train.json", "canonical_dev.json", "canonical_test.json"),
    ),
    "liputan6_xtreme": (
        "parallel", "generation", "BLEU", "liputan6", ("canonical_train.json", "xtreme_dev.json", "xtreme_test.json"),
    ),
    "tydi-qa": (
        "question", "answers", "F1", "question_answering",
        ("train_preprocess.json", "valid_preprocess.json", "test_preprocess.json"),
    ),
}
# labelling task: reader, metric bundle
LABELLING = {
    "aspect_extraction": ("tagged_any_break", "chunks"),
    "ner_grit": ("tagged", "chunks"),
    "ner_prosa": ("tagged", "chunks"),
    "pos_idn": ("tagged", "chunks"),
    "pos_prosa": ("tagged", "chunks"),
    "keyword_extraction": ("tagged", "chunks"),
    "qa_factoid": ("factoid", "chunks"),
    "emotion": ("emotion", "classes"),
    "entailment": ("entailment", "classes"),
    "document_sentiment": ("sentiment", "classes"),
    "absa_hotel": ("absa_hotel", "multi_classes"),
    "absa_car": ("absa_car", "multi_classes"),
    "news_category": ("news", "multi_classes"),
}
# reader: form of the batches
LAYOUT_OF_READER = {
    "parallel": "pairs", "question": "question", "dialogue": "dialogue", "tagged": "tags", "tagged_any_break": "tags",
    "factoid": "span", "emotion": "single", "sentiment": "single", "entailment": "two_texts", "absa_hotel": "vector",
    "absa_car": "vector", "news": "several",
}
# ------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Task:
    """Everything a job needs to know about a task."""

    name: str
    reader: str
    metrics: str
    selection: str
    paths: dict[str, str] = field(default_factory=dict)
    source_language: str | None = None
    target_language: str | None = None
    source_code: str | None = None
    target_code: str | None = None
    swap: bool = False
    labels: tuple[str, ...] = ()
    aspects: tuple[str, ...] = ()

    @property
    def layout(self) -> str:
        """Form of the task's batches, see :mod:`textloom.plans.prepare`."""
        return LAYOUT_OF_READER[self.reader]


@dataclass(frozen=True)
class Markers:
    separator: int
    speaker_1: int
    speaker_2: int


TASKS: dict[str, Task] = {}
READERS: dict[str, Callable[..., DataFrame]] = {}


def register_task(task: Task) -> None:
    TASKS[task.name] = task


def register_reader(name: str, reader: Callable[..., DataFrame], layout: str | None = None) -> None:
    """``reader(spark, path, task)`` -> DataFrame; ``layout`` is the form of its batches."""
    READERS[name] = reader
    if layout is not None:
        LAYOUT_OF_READER[name] = layout


register_metric = bundles.register_metric


def task(name: str) -> Task:
    if name not in TASKS:
        raise ValueError(f"unknown task {name!r}")
    return TASKS[name]


def markers(model_type: str) -> Markers:
    family = model_family(model_type)
    if family not in MARKERS:
        raise ValueError(f"unknown model type {model_type!r}")
    return Markers(*MARKERS[family])


def _split_paths(folder: str, files: tuple[str, str, str]) -> dict[str, str]:
    return {s: f"./dataset/{folder}/{f}" for s, f in zip(("train", "valid", "test"), files)}


def _register_all() -> None:
    preprocessed = ("train_preprocess.json", "valid_preprocess.json", "test_preprocess.json")
    for name, (folder, source, target) in TRANSLATION.items():
        for swap in (False, True):
            (src, src_code), (tgt, tgt_code) = (target, source) if swap else (source, target)
            register_task(Task(
                name + ("-swap" if swap else ""), "parallel", "generation", "SacreBLEU",
                _split_paths(folder, preprocessed), src, tgt, src_code, tgt_code, swap,
            ))
    for name, (reader, metrics, selection, folder, files) in MONOLINGUAL.items():
        register_task(Task(
            name, reader, metrics, selection, _split_paths(folder, files),
            "[indonesia]", "[indonesia]", "id_ID", "id_ID",
        ))
    for name, (reader, metrics) in LABELLING.items():
        register_task(Task(
            name, reader, metrics, "F1", labels=tuple(LABELS[name]), aspects=tuple(ASPECTS.get(name, ())),
        ))


_register_all()


def task_table(spark: SparkSession) -> DataFrame:
    """The registry as a table."""
    rows = [
        (t.name, t.reader, t.metrics, t.selection, t.paths.get("train"), t.paths.get("valid"), t.paths.get("test"),
         t.source_language, t.target_language, t.source_code, t.target_code, t.swap, len(t.labels), t.layout)
        for t in TASKS.values()
    ]
    return spark.createDataFrame(
        rows,
        "name string, reader string, metrics string, selection string, train string, valid string, test string, "
        "source_language string, target_language string, source_code string, target_code string, swap boolean, "
        "n_labels int, layout string",
    )


def language_id(token: str) -> int:
    """Id of a language token; both spellings of a language are known."""
    token = LANGUAGE_ALIASES.get(token, token)
    if token not in LANGUAGE_TOKENS:
        raise ValueError(f"unknown language token {token!r}")
    return LANGUAGE_TOKENS[token]


def language_code_ids(model_size: int) -> dict[str, int]:
    """Codes follow the model's pieces, moved up by one."""
    return {code: model_size + i + 1 for i, code in enumerate(LANGUAGE_CODES)}


def language_id_table(spark: SparkSession, model_size: int) -> DataFrame:
    codes = F.posexplode(F.array(*[F.lit(c) for c in LANGUAGE_CODES])).alias("i", "code")
    return spark.range(1).select(codes).select(
        "code", (F.col("i") + model_size + 1).cast("bigint").alias("language_id")
    )


def orient(df: DataFrame, source: str = "text", target: str = "label", swap: bool = False) -> DataFrame:
    """Rename the text columns to ``source`` and ``target``, exchanged if asked."""
    first, second = (target, source) if swap else (source, target)
    rest = [c for c in df.columns if c not in (source, target)]
    return df.select(*rest, F.col(first).alias("source"), F.col(second).alias("target"))


def read_task(spark: SparkSession, name: str, split: str, path: str | None = None) -> DataFrame:
    """One split of a task; swapped tasks come exchanged."""
    from ..sources import readers  # noqa: F401  (registers the readers)

    t = task(name)
    where = path or t.paths.get(split)
    if where is None:
        raise ValueError(f"task {name!r} has no path for {split!r}; give one")
    return READERS[t.reader](spark, where, t)


def score_predictions(name: str, predictions: DataFrame, **columns) -> DataFrame:
    """``(metric, value)`` of a task for a table ``(id, hyp, label)``."""
    return bundles.score(task(name).metrics, predictions, **columns)


def gold_labels(t: Task) -> Column:
    """Labels of a labelling task as read: tags of a sentence, a label name, one name per aspect, or for several
    labels a row a 0/1 vector over the task's labels."""
    if t.metrics == "chunks":
        return F.col("seq_label" if t.reader == "factoid" else "tags")
    if t.aspects:
        return F.array(*[F.col(a) for a in t.aspects])
    if t.metrics == "multi_classes":
        return multi_hot(F.col("label_indices"), len(t.labels))
    return F.col("sentiment" if t.reader == "sentiment" else "label")


def run_task(spark: SparkSession, name: str, hypotheses: DataFrame, path: str | None = None, split: str = "test") -> DataFrame:
    """Read a split, pair it with ``hypotheses(id, hyp)`` and score.

    Generation and answer tasks: the reference text is the lower-cased target, as it was encoded. Labelling tasks: ``hyp``
    has the form of :func:`gold_labels`.
    """
    from ..operators.predictions import pair_with_references

    rows = read_task(spark, name, split, path)
    t = task(name)
    if t.reader == "parallel":
        rows = orient(rows, swap=t.swap).select("id", F.lower("target").alias("label"))
    elif t.reader == "question":
        rows = rows.select("id", F.lower("label").alias("label"))
    elif t.reader == "dialogue":
        rows = rows.select("id", F.lower("reply").alias("label"))
    elif t.labels:
        rows = rows.select("id", gold_labels(t).alias("label"))
    return score_predictions(name, pair_with_references(hypotheses, rows))
