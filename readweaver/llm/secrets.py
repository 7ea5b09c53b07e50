"""Secret scans: base patterns and character Markov models, in DataFrame functions only.

Base spans are the patterns' leftmost matches in the whole text; their places
come from the lengths of matches and of the pieces between them.  Beyond those,
every run of 20 or more token characters is scored by two first-order character
Markov models, one of random strings and one of ordinary identifiers: the sum
over its character pairs of the log-likelihood ratio.  Runs whose mean ratio per
pair exceeds a fixed threshold are added.  Characters of base spans count as
gaps, so the parts of a run around a base span are scored on their own.

Time follows the length of the text and the number of spans m as m ** 1.5 at most:
prefix sums and cuts go by blocks of the square root of m, and a run's characters
are taken apart once.

The models are counts of character pairs in labelled samples, at most 65 * 65
numbers, smoothed and made into one literal array; the default samples are made
by a rule (digests of numbers; joined common words).

Defined results: a null text is the empty text, with no spans; repeated rows
give a row each; an empty table gives an empty table; other columns are
ignored; spans are in code points, the end exclusive, in the order start, kind.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import table, texts

#: kind, pattern, shortest kept group, its least length (fixed values)
PATTERNS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
RANDOM_RUN = r"[A-Za-z0-9+/_=-]{20,}"
#: Mean log-likelihood ratio per character pair, in nats, from which a run counts as random.
THRESHOLD = 0.5
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Parts of the ordinary identifiers of the default sample.
PARTS = (
    "get set read write open close user name count index value table column row file path input output buffer stream list array map key item node tree graph edge "
    "string number format parse print load save store cache query result error message request response server client session config option default width height color "
    "image text line word page document section title header footer button event handler listener callback function method class object instance static public private "
    "return create update delete insert select remove append merge split join filter sort search find replace match pattern token lexer parser compiler runtime memory "
    "thread process worker queue stack heap pointer reference address network socket connection database transaction commit rollback version release build test check "
    "and the that this with from have which there their about would other into more some could time these than first been its who now people made over down only "
    "international communication organisation development information environment understanding responsibility"
).split()


def default_samples(spark: SparkSession, n: int = 2000) -> DataFrame:
    """(sample, random): n random strings (hex, base64 and mixed digits of digests) and n ordinary identifiers (joined common words)."""
    ids = spark.range(0, 2 * n, 1, 1).select(F.col("id"), F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")), 256).alias("d"))
    parts = ", ".join(f"'{p}'" for p in PARTS)
    words = f"transform(sequence(0, 3), i -> element_at(array({parts}), 1 + cast(conv(substring(d, 1 + 7 * i, 7), 16, 10) as int) % {len(PARTS)}))"
    text = F.when(F.col("id") < n, F.when(F.col("id") % 3 == 0, F.substring("d", 1, 40)).otherwise(F.regexp_replace(F.base64(F.unhex("d")), "=", "")))
    ordinary = F.expr(f"case id % 4 when 0 then array_join({words}, '_') when 1 then array_join({words}, '') when 2 then replace(initcap(array_join({words}, ' ')), ' ', '') else array_join({words}, '-') end")
    return ids.select(text.alias("r"), ordinary.alias("o"), "id").select(F.coalesce("r", "o").alias("sample"), (F.col("id") < n).alias("random"))


def train(samples: DataFrame, alpha: float = 0.5) -> list[float]:
    """Log-likelihood ratio of each character pair (row-major over the alphabet) from (sample, random) rows.

    Transition probabilities are smoothed with alpha; pairs with a character outside the alphabet are left out.
    """
    pairs = samples.where("length(sample) > 1").select("random", F.explode(F.expr("transform(sequence(1, length(sample) - 1), i -> substring(sample, i, 2))")).alias("pair"))
    pairs = pairs.where(F.col("pair").rlike("^[" + ALPHABET.replace("-", "") + "-]{2}$"))
    rows = pairs.groupBy("random", "pair").count().collect()  # at most 2 * len(ALPHABET) ** 2 rows
    k = len(ALPHABET)
    at = {c: i for i, c in enumerate(ALPHABET)}
    seen = [[[alpha] * k for _ in range(k)] for _ in range(2)]
    for r in rows:
        a, b = r["pair"]
        seen[bool(r["random"])][at[a]][at[b]] += r["count"]
    p = [[[math.log(x / sum(row)) for x in row] for row in m] for m in seen]
    return [p[1][a][b] - p[0][a][b] for a in range(k) for b in range(k)]


SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _none() -> Column:
    return F.expr(f"cast(array() as {SPAN})")


def _let(value: Column, body) -> Column:
    """body(value), the value worked out once; in a lambda a plain expression would be for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _blocks(rows: Column) -> Column:
    """The array, a bound one, cut into arrays of about the square root of its size."""

    def cut(width: Column) -> Column:
        count = F.ceil(F.size(rows) / width).cast("int")
        return F.transform(F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.expr("cast(array() as array<int>)")), lambda b: F.slice(rows, b * width + 1, width))

    return _let(F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(rows))).cast("int")), cut)


def _before(values: Column, combine) -> Column:
    """What `combine` makes of the numbers before each, from 0 on; it is associative."""

    def scan(row: Column, zero: Column) -> Column:
        start = F.struct(zero.alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
        return F.aggregate(row, start, lambda acc, x: F.struct(combine(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def whole(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), combine))
        return F.flatten(F.zip_with(blocks, scan(totals, F.lit(0)), scan))

    return _let(values, lambda v: _let(_blocks(v), whole))


def _matches(text: Column, pattern: str, group: int, offset: Column) -> Column:
    """(start, end, size of the group, whole match) of the pattern's matches, the start counted from offset."""
    p = F.lit(pattern)

    def sized(whole: Column) -> Column:
        own = F.regexp_extract_all(text, p, F.lit(group)) if group else whole
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole))
        both = F.zip_with(whole, own, lambda m, g: F.struct(m.alias("m"), F.length(m).alias("size"), F.length(g).alias("g")))
        return F.zip_with(both, gaps, lambda x, gap: F.struct(F.length(gap).alias("gap"), x["m"].alias("m"), x["size"].alias("size"), x["g"].alias("g")))

    def placed(x: Column, at: Column) -> Column:
        start = offset + at + x["gap"]
        return F.struct(start.alias("start"), (start + x["size"]).alias("end"), x["g"].alias("g"), x["m"].alias("m"))

    found = _let(F.regexp_extract_all(text, p, F.lit(0)), sized)
    return _let(found, lambda f: F.zip_with(f, _before(F.transform(f, lambda x: x["gap"] + x["size"]), lambda x, y: x + y), placed))


def _span(x: Column, kind: str, rank: int) -> Column:
    return F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"))


def _spans(text: Column, kind: str, rank: int, pattern: str, group: int, least: int) -> Column:
    """Spans of the pattern's matches whose group has `least` characters or more."""
    found = F.transform(F.filter(_matches(text, pattern, group, F.lit(0)), lambda x: x["g"] >= least), lambda x: _span(x, kind, rank))
    return F.when(text.rlike(pattern if kind == "assign" else pattern.removesuffix("+") + f"{{{least - (4 if kind == 'access' else 0)},}}"), found).otherwise(_none())


def _cuts(text: Column, spans: Column) -> Column:
    """(a, b) of the stretches outside the spans, which are in order: one before each span that starts after the others' ends, and one after all."""

    def outside(ends: Column) -> Column:
        between = F.filter(F.zip_with(spans, _before(ends, lambda x, y: F.greatest(x, y)), lambda s, r: F.struct(r.alias("a"), s["start"].alias("b"))), lambda c: c["a"] <= c["b"])
        return F.concat(between, F.array(F.struct(F.coalesce(F.array_max(ends), F.lit(0)).alias("a"), F.length(text).alias("b"))))

    return _let(F.transform(spans, lambda s: s["end"]), outside)


def _pieces(text: Column, cuts: Column) -> Column:
    """The text's characters from a to b of each cut."""

    def block(part: Column) -> Column:
        first = F.element_at(part, 1)["a"]
        return F.struct(part.alias("part"), first.alias("first"), F.substring(text, first + 1, F.element_at(part, -1)["b"] - first).alias("own"))

    return _let(cuts, lambda cut: F.flatten(F.transform(F.transform(_blocks(cut), block), lambda x: F.transform(x["part"], lambda c: F.substring(x["own"], c["a"] - x["first"] + 1, c["b"] - c["a"])))))


def _random_spans(text: Column, base: Column, ratios: list[float]) -> Column:
    """Spans of the random runs of a text outside its base spans."""
    k = len(ALPHABET)
    table_ = F.split(F.lit(",".join(f"{x:.4f}" for x in ratios)), ",").cast("array<double>")  # folded to a literal when planned
    codes = F.split(F.lit(",".join(str(ALPHABET.find(chr(i))) for i in range(128))), ",").cast("array<int>")

    def mean(s: Column) -> Column:
        def step(acc: Column, c: Column) -> Column:
            code = F.get(codes, F.ascii(c))
            return F.struct(code.alias("last"), (acc["sum"] + F.when(acc["last"] < 0, F.lit(0.0)).otherwise(F.get(table_, acc["last"] * k + code))).alias("sum"))

        return F.aggregate(F.split(s, ""), F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum")), step, lambda acc: acc["sum"]) / (F.length(s) - 1)

    def runs(piece: Column, at: Column) -> Column:
        found = F.filter(_matches(piece, RANDOM_RUN, 0, at), lambda x: mean(x["m"]) >= THRESHOLD)
        return F.when(piece.rlike(RANDOM_RUN), F.transform(found, lambda x: _span(x, "random", len(PATTERNS)))).otherwise(_none())

    outside = _let(_cuts(text, base), lambda cuts: F.flatten(F.zip_with(_pieces(text, cuts), cuts, lambda piece, c: runs(piece, c["a"]))))
    return F.when(~text.rlike(RANDOM_RUN), _none()).when(F.size(base) == 0, runs(text, F.lit(0))).otherwise(outside)


def scan(docs: DataFrame, ratios: list[float], keep: tuple[str, ...] = (), text: str = "text") -> DataFrame:
    """The columns `keep` and base and added spans (array of start, rank, end, kind, in order) of each row as secret_base and secret_spans."""
    body = F.coalesce(F.col(text), F.lit(""))
    found = docs.select(*keep, body.alias("secret_text"), *(_spans(body, k, i, p, g, n).alias(f"secret_{k}") for i, (k, p, g, n) in enumerate(PATTERNS)))
    found = found.select(*keep, "secret_text", F.array_sort(F.concat(*(F.col(f"secret_{k}") for k, *_ in PATTERNS))).alias("secret_base"))
    found = found.select("*", _random_spans(F.col("secret_text"), F.col("secret_base"), ratios).alias("secret_added"))
    return found.select(*keep, "secret_text", "secret_base", F.array_sort(F.concat("secret_base", "secret_added")).alias("secret_spans"))


def redact(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with each span, overlapping ones as one, replaced by the mask."""
    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(_pieces(text, _cuts(text, spans)), mask))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(texts(table(spark, sf_dir, "documents")), train(default_samples(spark)), ("doc_id",))
    count = lambda kind: F.size(F.filter("secret_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k, *_ in PATTERNS), F.sha2(listed(F.col("secret_base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("secret_spans")).alias("spans"))
