"""Secret scan: fixed patterns, and character Markov models compared by log-likelihood ratio.

Built-in functions only. The two models (random strings, ordinary identifiers) are first-order chains over character
classes, counted by Spark from labelled samples; what reaches a scan is one table of log-odds whose size is fixed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kind, pattern, group that is measured, least length of it. Listed in the order in which equal starts sort.
BASE_KINDS = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
]
#: The same matches found faster: no shorter run can hold one that is long enough.
FAST = {"access": r"AKIA[A-Z0-9]{16,}+", "hex": r"[0-9a-f]{24,}+"}
MARKOV = "markov"
#: Numbers added up at a time.
BLOCK = 128
#: Strings that the models judge: runs of these characters as far as a base span begins in them; what is left of a run
#: behind a base span belongs to that, up to where an assignment begins. The first group is the string.
RUN = "[A-Za-z0-9+/_-]"
ASSIGN = r"""(?i:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}+)"""
OTHERS = "AKIA[A-Z0-9]{16}|[0-9a-f]{24}"
CANDIDATE = f"(?:{ASSIGN}|(?={OTHERS}))(?:(?!{ASSIGN}){RUN})*+|(?<!{RUN})(?={RUN}{{20}})((?:(?!{ASSIGN}|{OTHERS}){RUN}){{20,}}+={{0,2}})"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-="
#: Classes: one for each character of the alphabet and one for the string's edge.
CLASSES = len(ALPHABET) + 1

#: Parts of which the labelled sample of ordinary identifiers is put together.
IDENTIFIER_PARTS = (
    "account action address after array average batch before begin between block body branch buffer build button bytes cache call "
    "change channel check child class client close cluster code column command commit common config connect content context "
    "control copy count create current data date default delete detail device directory document download driver edge element "
    "enable end entry error event example execute export factory field file filter find first flag folder font form format function "
    "general global graph group handle header height history host image import index info input insert install interface item job "
    "join key kind label language last layer left length level library license limit line link list load local lock log lookup main "
    "manager map mark match memory menu merge message method metric mode model module name network next node notification number "
    "object offset open operation option order output package page parent parse partition path pattern permission phone player "
    "point policy position post prefix previous print process product profile project property provider public query queue range "
    "read record reference region register release remove render report request reset resource response result return right root "
    "route row rule sample schedule schema scope screen script search section select server service session set settings shape "
    "shared show size sort source space spark start state station status step stop storage store stream string style submit table "
    "target task template test text the thread time title token tool total transaction transfer tree type under unit update upload "
    "user utility value version video view visible volume widget width window word work worker write zone international "
    "understanding responsible unfortunately characteristic nevertheless administration"
).split()


@dataclass(frozen=True)
class MarkovModel:
    """log_odds[a * CLASSES + b]: log P(b | a) under random strings less that under identifiers."""

    log_odds: tuple[float, ...]


def labelled_samples(spark: SparkSession, rows: int = 4000) -> DataFrame:
    """(text, random): ``rows`` strings of each label, the same every time. Digests stand for random strings."""
    words = F.array(*[F.lit(w) for w in IDENTIFIER_PARTS])
    ids = spark.range(0, rows, 1, 4)
    digest = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 256)
    b64 = F.regexp_replace(F.base64(F.unhex(digest)), r"\s", "")
    text = F.when(F.col("id") % 4 == 0, digest).when(F.col("id") % 4 == 1, F.upper(F.substring(digest, 1, 40))).otherwise(b64)
    part = lambda k: F.get(words, F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(IDENTIFIER_PARTS))).cast("int"))
    style = F.col("id") % 6
    low = [part(k) for k in range(4)]
    cap = [F.initcap(x) for x in low]
    name = (
        F.when(style == 0, F.concat(low[0], cap[1], cap[2], cap[3]))
        .when(style == 1, F.concat_ws("_", *low))
        .when(style == 2, F.upper(F.concat_ws("_", *low)))
        .when(style == 3, F.concat_ws("-", *low))
        .when(style == 4, F.concat_ws("/", *low[:3], F.concat(F.lit("v"), (F.col("id") % 10).cast("string"))))
        .otherwise(F.concat(*low))
    )
    return ids.select(text.alias("text"), F.lit(True).alias("random")).unionAll(ids.select(name.alias("text"), F.lit(False).alias("random")))


def class_at(text: Column, i: Column) -> Column:
    """Class of the character at ``i`` (from 1); the edge's outside the string."""
    c = F.substring(text, i, F.lit(1))
    return F.when((i < 1) | (i > F.length(text)), F.lit(CLASSES - 1)).otherwise(F.instr(F.lit(ALPHABET), c) - 1)


def train(samples: DataFrame) -> MarkovModel:
    """Transition counts of each label, plus one half each; at most 2 * CLASSES ** 2 counts reach the driver.

    Null texts and strings with other characters count as far as they are within the alphabet.
    """
    chars = samples.where(F.col("text").isNotNull()).select("random", F.col("text").cast("string").alias("text"))
    steps = chars.select("random", "text", F.explode(F.sequence(F.lit(1), F.length("text") + 1)).alias("i"))
    moves = steps.select("random", class_at(F.col("text"), F.col("i") - 1).alias("a"), class_at(F.col("text"), F.col("i")).alias("b"))
    counts = moves.where("a >= 0 and b >= 0").groupBy("random", "a", "b").count().collect()
    seen = {True: [0.5] * CLASSES**2, False: [0.5] * CLASSES**2}
    for r in counts:
        seen[r["random"]][r["a"] * CLASSES + r["b"]] += r["count"]
    odds = []
    for a in range(CLASSES):
        rows = {k: v[a * CLASSES : (a + 1) * CLASSES] for k, v in seen.items()}
        sums = {k: sum(v) for k, v in rows.items()}
        odds += [math.log(rows[True][b] / sums[True]) - math.log(rows[False][b] / sums[False]) for b in range(CLASSES)]
    return MarkovModel(tuple(odds))


@cache
def _default_model(app: str) -> MarkovModel:
    return train(labelled_samples(SparkSession.active()))


def default_model(spark: SparkSession) -> MarkovModel:
    """Trained on the built-in samples, once for each application."""
    return _default_model(spark.sparkContext.applicationId)


def log_likelihood_ratio(token: Column, model: MarkovModel) -> Column:
    """Mean log-odds of a step of ``token``: above 0 if random strings explain it better. One pass over its characters."""
    # one literal, which is folded into an array: thousands of literals would be as many nodes of the plan, three times
    table = F.split(F.lit(",".join(map(repr, model.log_odds))), ",").cast("array<double>")
    edge = F.lit(CLASSES - 1)
    odds = lambda a, b: F.get(table, a * F.lit(CLASSES) + b)
    one = lambda c: F.instr(F.lit(ALPHABET), c) - 1
    step = lambda acc, c: F.struct(one(c).alias("last"), (acc["sum"] + odds(acc["last"], one(c))).alias("sum"))
    chars = F.filter(F.split(token, "", -1), lambda c: c != "")
    total = F.aggregate(chars, F.struct(edge.alias("last"), F.lit(0.0).alias("sum")), step, lambda acc: acc["sum"] + odds(acc["last"], edge))
    return total / (F.length(token) + 1)


def running_sums(numbers: Column) -> Column:
    """The sum of each number and all before it, within blocks of numbers first, as an array grows by being copied."""
    last = lambda x: F.coalesce(F.element_at(x, -1), F.lit(0))
    along = lambda x: F.aggregate(x, F.array().cast("array<int>"), lambda acc, n: F.array_append(acc, (F.when(F.size(acc) > 0, last(acc)).otherwise(0) + n).cast("int")))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / BLOCK).cast("int")), lambda k: along(F.slice(numbers, k * BLOCK + 1, F.lit(BLOCK))))

    def joined(x: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), along(F.transform(F.slice(x, F.lit(1), F.size(x) - 1), last)))
        return F.flatten(F.zip_with(x, before, lambda block, n: F.transform(block, lambda v: v + n)))

    # through a list of one, so that the blocks are computed once
    return F.when(F.size(numbers) > 0, F.get(F.transform(F.array(blocks), joined), F.lit(0))).otherwise(F.array().cast("array<int>"))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, found>> of leftmost non-overlapping matches, in code points, end exclusive.

    Splitting by a pattern gives what lies between the matches that extraction gives.
    """
    out = "array<struct<start:int,end:int,found:string>>"
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole

    def spans(pieces: Column) -> Column:
        ends = running_sums(F.transform(pieces, lambda x: x["gap"] + x["size"]))
        return F.zip_with(pieces, ends, lambda x, end: F.struct((end - x["size"]).alias("start"), end.alias("end"), x["part"].alias("found")))

    sizes = F.transform(whole, lambda w: F.length(w))
    pieces = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(whole)).alias("gap"), sizes.alias("size"), part.alias("part"))
    # through a list of one, so that the text is read once
    found = F.get(F.transform(F.array(pieces), spans), F.lit(0))
    return F.when(F.rlike(text, F.lit(pattern)), found.cast(out)).otherwise(F.array().cast(out))


def scan_secrets(docs: DataFrame, model: MarkovModel | None = None, threshold: float = 0.6) -> DataFrame:
    """One row per row of ``docs``: doc_id, spans array<struct<start, rank, end, kind, found>> by start, then kind.

    Kinds are those of BASE_KINDS, and ``markov``: a candidate string, which touches no base span, whose mean
    log-likelihood ratio is at least ``threshold``. Null and empty texts have no spans. Repeated rows give repeated results; other columns are ignored; an
    empty table gives an empty result. The whole text is read, in time that is in proportion to its length.
    """
    model = model or default_model(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))
    kinds = []
    for rank, (kind, pattern, group, least) in enumerate(BASE_KINDS):
        found = F.filter(matches(F.col("__text"), FAST.get(kind, pattern), group), _at_least(least))
        rows = rows.withColumn(f"__{kind}", F.transform(found, _span(rank, kind)))
        kinds.append(f"__{kind}")
    rows = rows.withColumn("__base", F.concat(*kinds))
    random = lambda m: (m["found"] != "") & (log_likelihood_ratio(m["found"], model) >= F.lit(threshold))
    more = F.filter(matches(F.col("__text"), CANDIDATE, 1), random)
    rows = rows.withColumn("__more", F.transform(more, _span(len(BASE_KINDS), MARKOV)))
    return rows.select("doc_id", F.array_sort(F.concat("__base", "__more")).alias("spans"))


def _at_least(n: int):
    return lambda m: F.length(m["found"]) >= n


def _span(rank: int, kind: str):
    return lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"), m["found"].alias("found"))
