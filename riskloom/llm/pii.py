"""Personal data by candidate gradient boosting, in DataFrame expressions only.

High-recall patterns propose spans, which may overlap; boosted trees score each from its format and its context;
a threshold per kind, calibrated on all rows that the trees were not fitted on, selects. Spans that a strict rule confirms (``base``) are
always kept. Spans are code point positions, end exclusive.

There are no labels of personal data, so the trees learn from rules: a candidate is an example of its kind if the
strict rule confirms it; a wide proposal of e-mail if it ends in a known top-level name, of phone if words like ``call`` or
``write`` stand before it, of secrets if it is assigned to a word like ``token`` and mixes letters and digits. The trees
do not see which pattern proposed a candidate. Each group of pattern and label weighs the same, however rare it is, and
thresholds come from the candidates they decide on, that is, those which no strict rule confirms.
They are fitted on the candidates of at most ``MAX_TRAIN`` rows with a digit or ``(at)``, those with the smallest hash. Thresholds and
everything that is scored run over all rows, whole texts; a null text counts as empty.

Patterns use possessive repetition: they never go back, so long runs cost linear time and no stack.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import hash_sample

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
MAX_TRAIN = 4_000
TREES, DEPTH, SEED = 8, 3, 11
PRECISION = 0.95
BLOCK = 256

# A match of one of these starts where the plain pattern's leftmost match would: at the start of its run of
# characters, or right after the match before.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Further proposals of the same kinds, wider than the strict patterns, and of secrets.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[(\[] ?at ?[)\]] ?[A-Za-z0-9-]{1,63}+ ?(?:\.|[(\[] ?dot ?[)\]]) ?[A-Za-z]{2,24}+",
    "phone": r"(?<![0-9+])\(?[0-9]{2,4}+\)?[ .-][0-9]{3,4}+[ .-][0-9]{3,5}+(?![0-9])",
    "secret": r"(?i)(?<![A-Za-z])(?:token|secret|password|passwd|pwd|api_?key)[\x22']?\s?[=:]\s?[\x22']?[A-Za-z0-9_+/=-]{8,}+[\x22']?",
}
# A text without these characters or words has no match; checked before the pattern is tried.
GUARDS = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9][\\x20-]?[0-9]", "phone": "\\+[0-9]"}
WIDE_GUARDS = {"email": "(?:[(\\[]) ?at ?(?:[)\\]])", "phone": "[0-9][ .-][0-9]{3}", "secret": "(?i)token|secret|passw|pwd|key"}

FEATURES = ("kind", "length", "digits", "letters", "separators", "luhn", "octets", "at", "plus", "word_before",
            "word_after", "says_phone", "says_card", "says_host", "says_mail", "says_secret", "top_name", "plus_before")

# Top-level names: the common general ones and those of countries.
TOP_NAMES = (
    "com|org|net|edu|gov|mil|int|info|biz|name|pro|mobi|asia|coop|museum|aero|jobs|tel|cat|arpa|app|dev|io|ai|xyz|online|site|shop|tech|blog|cloud|"
    "ac|ad|ae|af|ag|al|am|ao|ar|as|at|au|aw|ax|az|ba|bb|bd|be|bf|bg|bh|bi|bj|bm|bn|bo|br|bs|bt|bw|by|bz|ca|cc|cd|cf|cg|ch|ci|ck|cl|cm|cn|co|"
    "cr|cu|cv|cw|cx|cy|cz|de|dj|dk|dm|do|dz|ec|ee|eg|er|es|et|eu|fi|fj|fk|fm|fo|fr|ga|gd|ge|gf|gg|gh|gi|gl|gm|gn|gp|gq|gr|gs|gt|gu|gw|gy|hk|"
    "hm|hn|hr|ht|hu|id|ie|il|im|in|iq|ir|is|it|je|jm|jo|jp|ke|kg|kh|ki|km|kn|kp|kr|kw|ky|kz|la|lb|lc|li|lk|lr|ls|lt|lu|lv|ly|ma|mc|md|me|mg|"
    "mh|mk|ml|mm|mn|mo|mp|mq|mr|ms|mt|mu|mv|mw|mx|my|mz|na|nc|ne|nf|ng|ni|nl|no|np|nr|nu|nz|om|pa|pe|pf|pg|ph|pk|pl|pm|pn|pr|ps|pt|pw|py|qa|"
    "re|ro|rs|ru|rw|sa|sb|sc|sd|se|sg|sh|si|sk|sl|sm|sn|so|sr|ss|st|su|sv|sx|sy|sz|tc|td|tf|tg|th|tj|tk|tl|tm|tn|to|tr|tt|tv|tw|tz|ua|ug|uk|"
    "us|uy|uz|va|vc|ve|vg|vi|vn|vu|wf|ws|ye|yt|za|zm|zw")

OCTETS = "^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])(?:\\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])){3}$"

_SAYS_PHONE, _SAYS_MAIL = "phone|call|mobile|tel|fax", "mail|contact|write"
_TOP_NAME = f"(?i)(?:\\.|[(\\[] ?dot ?[)\\]]) ?(?:{TOP_NAMES})$"
#: Ends inside a number with a plus: a local number found there is a part of that number.
_PLUS_BEFORE = "\\+[0-9][\\x20().0-9-]*$"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Luhn sum of a digit string is a multiple of ten. Only ever called on short strings."""
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(back, i, 1).cast("int") * (F.lit(2) - i % 2)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once a row, also where the body's lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(steps: Column) -> Column:
    """Running sums of an integer array; sums of blocks keep long arrays from costing their square."""
    sums = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    block = lambda i: F.floor(i / BLOCK).cast("int")
    totals = F.transform(F.sequence(F.lit(0), block(F.greatest(F.size(steps) - 1, F.lit(0)))),
                         lambda b: sums(F.slice(steps, b * BLOCK + 1, F.lit(BLOCK))))
    return _let(totals, lambda t: F.transform(steps, lambda _, i: (
        sums(F.slice(t, F.lit(1), block(i))) + sums(F.slice(steps, block(i) * BLOCK + 1, i % BLOCK + 1)))))


def with_matches(df: DataFrame, text: str, pattern: str, guard: str, out: str) -> DataFrame:
    """Add ``out``: all non-overlapping matches, leftmost first, as (start, end, value, before, after).

    The pieces between matches give the positions: a match starts after all pieces and matches before it.
    ``before`` and ``after`` are the neighbouring characters up to the next match, 24 and 1 at most.
    """
    none = F.array().cast("array<string>")

    def hits(s: Column) -> Column:
        values, pieces = s["v"], s["p"]
        steps = F.transform(values, lambda _, i: F.length(F.get(pieces, i)) + F.coalesce(F.length(F.get(values, i - 1)), F.lit(0)))
        return _let(steps, lambda st: _let(_running(st), lambda starts: F.transform(values, lambda v, i: F.struct(
            F.get(starts, i).alias("start"), (F.get(starts, i) + F.length(v)).alias("end"), v.alias("value"),
            F.substring(F.get(pieces, i), -24, 24).alias("before"),
            F.substring(F.coalesce(F.get(pieces, i + 1), F.lit("")), 1, 1).alias("after")))))

    values = F.when(F.col(text).rlike(guard), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)
    split = lambda v: F.struct(v.alias("v"), F.when(F.size(v) > 0, F.split(text, pattern, -1)).otherwise(none).alias("p"))
    return df.withColumn(out, _let(values, lambda v: _let(split(v), hits)))


def confirmed(kind: str, value: Column) -> Column:
    """The strict rule of a base kind, for a match of its pattern."""
    n = F.length(_digits(value))
    return {
        "email": F.lit(True),
        "ip": value.rlike(OCTETS),
        "card": n.between(16, 19) & _luhn(F.when(n.between(16, 19), _digits(value)).otherwise(F.lit("0"))),
        "phone": n.between(8, 15),
    }[kind]


def _candidate(kind: str, wide: bool):
    number = KINDS.index(kind)

    def make(x: Column) -> Column:
        value, digits = x["value"], _digits(x["value"])
        says = lambda words: x["before"].rlike(f"(?i)(?:{words})").cast("int")
        if wide and kind == "secret":
            key = value.rlike("[A-Za-z0-9_+/-]{16,}") & value.rlike("[=:].*[0-9]") & value.rlike("[=:].*[A-Za-z]")
            truth = key
        elif wide and kind == "email":
            truth = value.rlike(_TOP_NAME)
        elif wide:
            truth = x["before"].rlike(f"(?i)(?:{_SAYS_PHONE}|{_SAYS_MAIL})") & ~value.rlike(OCTETS) & ~x["before"].rlike(_PLUS_BEFORE)
        else:
            truth = confirmed(kind, value)
        return F.struct(
            x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("name"), truth.alias("confirmed"),
            F.lit(number).alias("kind"), F.length(value).alias("length"), F.length(digits).alias("digits"),
            F.length(F.regexp_replace(value, "[^A-Za-z]", "")).alias("letters"),
            F.length(F.regexp_replace(value, "[^ ().-]", "")).alias("separators"),
            F.when(F.length(digits).between(12, 19), _luhn(F.when(F.length(digits).between(12, 19), digits).otherwise(F.lit("0"))))
            .otherwise(False).cast("int").alias("luhn"),
            value.rlike(OCTETS).cast("int").alias("octets"), value.contains("@").cast("int").alias("at"),
            value.startswith("+").cast("int").alias("plus"),
            x["before"].rlike("[A-Za-z0-9]$").cast("int").alias("word_before"),
            x["after"].rlike("^[A-Za-z0-9]").cast("int").alias("word_after"),
            says(_SAYS_PHONE).alias("says_phone"), says("card|visa|credit|pay").alias("says_card"),
            says("host|server|addr|\\bip\\b").alias("says_host"), says(_SAYS_MAIL).alias("says_mail"),
            says("token|secret|key|passw").alias("says_secret"), value.rlike(_TOP_NAME).cast("int").alias("top_name"),
            x["before"].rlike(_PLUS_BEFORE).cast("int").alias("plus_before"), F.lit(int(wide)).alias("wide"))

    return make


def candidates(df: DataFrame, text: str, out: str = "candidates") -> DataFrame:
    """Rows pass through whole, with ``out``: all proposed spans of the text with their features.

    ``confirmed`` marks base spans. A null text has none.
    """
    source = "__whole"
    df = df.withColumn(source, F.coalesce(F.col(text), F.lit("")))
    parts = []
    for kind in KINDS:
        for wide, patterns, guards in ((False, PATTERNS, GUARDS), (True, WIDE, WIDE_GUARDS)):
            if kind in patterns:
                name = f"__{kind}_{int(wide)}"
                df = with_matches(df, source, patterns[kind], guards[kind], name)
                parts.append((name, _candidate(kind, wide)))
    return df.withColumn(out, F.concat(*[F.transform(F.col(n), f) for n, f in parts])).drop(source, *[n for n, _ in parts])


@dataclass
class Model:
    """Boosted trees as text of conditions on candidate fields, and the least score of each kind.

    A kind that is missing from ``thresholds`` adds nothing to its confirmed spans.
    """

    trees: list[str] = field(default_factory=list)
    thresholds: dict[str, float] = field(default_factory=dict)

    def margin(self, fields: str) -> str:
        """SQL of the sum of trees; ``fields`` is the prefix of the feature names."""
        return " + ".join(t.replace("@", fields) for t in self.trees) or "0D"


def _tree_sql(lines: list[str], weight: float) -> str:
    """One tree of MLlib's printed form as a nested CASE."""
    line = lines.pop(0).strip()
    if found := re.fullmatch(r"Predict: (\S+)", line):
        return f"{float(found[1]) * weight!r}D"
    found = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", line)
    yes = _tree_sql(lines, weight)
    lines.pop(0)  # the matching Else
    no = _tree_sql(lines, weight)
    return f"(CASE WHEN @{FEATURES[int(found[1])]} <= {float(found[2])!r}D THEN {yes} ELSE {no} END)"


def fit(df: DataFrame, text: str, max_train: int = MAX_TRAIN, precision: float = PRECISION) -> Model:
    """Fit trees on four fifths of the sampled texts and set thresholds on all other rows of ``df``.

    Copies of a fitted text count as fitted. A kind that occurs in fitted texts only takes its threshold from them.
    The driver receives trees and one count per kind and hundredth of score. Without examples of both sorts the
    model is empty.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    # All columns take part in the hash, so that many copies of a text do not share one.
    columns = [f"`{f.name}`" for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    texts = hash_sample(df.filter(F.col(text).rlike("[0-9]|" + WIDE_GUARDS["email"])), columns, max_train).select(F.col(text).alias("text"))
    texts = texts.withColumn("row_hash", F.xxhash64("text"))
    rows = (candidates(texts.repartition(8, "row_hash"), "text").select("row_hash", F.explode("candidates").alias("c"))
            .select("row_hash", F.col("c.name").alias("name"), F.col("c.confirmed").cast("double").alias("label"), F.col("c.wide").alias("wide"),
                    *[F.col(f"c.{f}").cast("double").alias(f) for f in FEATURES]).persist())
    try:
        held = F.pmod(F.col("row_hash"), F.lit(5)) == 0
        groups = rows.filter(~held).groupBy("name", "wide", "label").count().collect()
        if {g["label"] for g in groups} != {0.0, 1.0}:
            return Model()
        weight = "CASE " + " ".join(f"WHEN name = '{g['name']}' AND wide = {g['wide']} AND label = {g['label']}D THEN {1000 / g['count']!r}D" for g in groups) + " END"
        assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(rows.filter(~held).withColumn("weight", F.expr(weight)))
        fitted = GBTClassifier(featuresCol="x", labelCol="label", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, seed=SEED, maxBins=64).fit(assembled)
        trees = [_tree_sql([x for x in t.toDebugString.splitlines()[1:] if x.strip()], w)
                 for t, w in zip(fitted.trees, fitted.treeWeights)]
        model = Model(trees)
        fitted_on = F.broadcast(rows.filter(~held).select("row_hash").distinct().withColumn("fitted", F.lit(True)))
        whole = df.select(F.col(text).alias("text")).withColumn("row_hash", F.xxhash64("text")).join(fitted_on, "row_hash", "left")
        bins = (candidates(whole, "text").select(F.col("fitted").isNotNull().alias("fitted"), F.explode("candidates").alias("c"))
                .filter("NOT (c.confirmed AND c.wide = 0)").withColumn("bin", F.floor(F.expr(f"100 / (1 + exp(-2 * ({model.margin('c.')})))")))
                .groupBy(F.col("c.name").alias("name"), "bin", "fitted")
                .agg(F.sum(F.col("c.confirmed").cast("long")).alias("hits"), F.count(F.lit(1)).alias("n")).collect())
        for kind in KINDS:
            of_kind = [r for r in bins if r["name"] == kind]
            apart = [r for r in of_kind if not r["fitted"]] or of_kind
            hits = n = 0
            for r in sorted(apart, key=lambda r: -r["bin"]):
                hits, n = hits + r["hits"], n + r["n"]
                if hits >= precision * n:
                    model.thresholds[kind] = r["bin"] / 100
        return model
    finally:
        rows.unpersist()


def spans(df: DataFrame, text: str, model: Model, out: str = "spans") -> DataFrame:
    """Rows pass through whole, with ``out``: array of (rank, start, end, kind, base), sorted by kind as listed, then start.

    ``base`` marks spans that a strict rule confirms; the others are those the trees select.
    """
    df = candidates(df, text, "__candidates")
    if model.thresholds:
        score = f"1 / (1 + exp(-2 * ({model.margin('c.')})))"
        limit = "CASE c.name " + " ".join(f"WHEN '{k}' THEN {v!r}D" for k, v in model.thresholds.items()) + " ELSE 2D END"
        picked = f"filter(__candidates, c -> (c.confirmed AND c.wide = 0) OR {score} >= {limit})"
    else:
        picked = "filter(__candidates, c -> c.confirmed AND c.wide = 0)"
    listed = f"array_sort(array_distinct(transform({picked}, c -> named_struct('rank', c.kind, 'start', c.start, 'end', c.end, 'kind', c.name, 'base', c.confirmed AND c.wide = 0))))"
    return df.withColumn(out, F.expr(listed)).drop("__candidates")


def redact(df: DataFrame, text: str, spans_column: str) -> DataFrame:
    """Replace each run of overlapping spans by ``[KIND]`` of its first span; null texts stay null."""
    runs = f"""aggregate(
        array_sort(transform({spans_column}, s -> named_struct('start', s.start, 'end', s.end, 'kind', s.kind))),
        cast(array() as array<struct<start:int,end:int,kind:string>>),
        (a, s) -> CASE WHEN size(a) > 0 AND s.start < element_at(a, -1).end
            THEN concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start,
                'end', greatest(element_at(a, -1).end, s.end), 'kind', element_at(a, -1).kind)))
            ELSE concat(a, array(s)) END)"""
    df = df.withColumn("__runs", F.expr(runs))
    whole = f"`{text}`"
    new = f"""concat(array_join(transform(__runs, (r, i) -> concat(
            substring({whole}, CASE WHEN i = 0 THEN 1 ELSE __runs[i - 1].end + 1 END,
                r.start - CASE WHEN i = 0 THEN 0 ELSE __runs[i - 1].end END), '[', upper(r.kind), ']')), ''),
        substring({whole}, element_at(__runs, -1).end + 1))"""
    return df.withColumn(text, F.when(F.size("__runs") > 0, F.expr(new)).otherwise(F.col(text))).drop("__runs")


def listing(spans_column: str) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(F.col(spans_column), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(df: DataFrame, id_column: str, text: str, model: Model) -> DataFrame:
    """Per row: doc_id, counts of base spans by kind, digest of the base listing, and the listing of all spans."""
    rows = spans(df.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text")), "text", model)
    rows = rows.withColumn("base", F.filter("spans", lambda s: s["base"]))
    rows = rows.withColumn("spans", F.array_distinct(F.transform("spans", lambda s: F.struct(s["rank"], s["start"], s["end"], s["kind"]))))
    return rows.select(
        "doc_id", *[F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(listing("base").cast("binary"), 256).alias("base_sha256"), listing("spans").alias("spans"))
