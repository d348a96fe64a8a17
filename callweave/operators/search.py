"""Full-text search over symbols: postings, BM25, boolean queries, the search ladder."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.operators.lookup import find_like, find_nodes, first_found, without_tests
from callweave.operators.trigrams import find_like_indexed

COLUMNS = ["name", "qualified_name", "signature", "doc_comment"]
#: BM25's constants.
K1, B = 1.2, 0.75
#: Latin letters with marks, and what they are without them.
_MARKED = {chr(c): unicodedata.normalize("NFD", chr(c))[0] for c in (*range(0xE0, 0x250), *range(0x1E00, 0x1F00))}
ACCENTED = "".join(c for c, base in _MARKED.items() if base != c and base.isascii() and c == c.lower())
PLAIN = "".join(_MARKED[c] for c in ACCENTED)


def tokens(text: Column) -> Column:
    """Runs of letters and digits, in lower case, without accents."""
    return F.regexp_extract_all(F.translate(F.lower(text), ACCENTED, PLAIN), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def index_rows(nodes: DataFrame) -> DataFrame:
    """term, id, col, pos of every token, and the number of the symbol's tokens: what a stored index holds."""
    fields = F.array(*[F.struct(F.lit(c).alias("col"), tokens(F.coalesce(c, F.lit(""))).alias("terms")) for c in COLUMNS])
    whole = nodes.select("id", fields.alias("fields"))
    whole = whole.select("id", "fields", F.aggregate("fields", F.lit(0), lambda n, f: n + F.size(f["terms"])).alias("tokens"))
    each = whole.select("id", "tokens", F.explode("fields").alias("f"))
    return each.select("id", "tokens", F.col("f.col").alias("col"), F.posexplode("f.terms").alias("pos", "term")).select("term", "id", "col", "pos", "tokens")


def postings(nodes: DataFrame) -> DataFrame:
    """id, col, term, pos of every token."""
    return index_rows(nodes).select("id", "col", "term", "pos")


class QuerySyntaxError(ValueError):
    """The query isn't in the grammar."""


@dataclass(frozen=True)
class Phrase:
    words: tuple[str, ...]
    prefix: bool = False
    columns: tuple[str, ...] | None = None
    first: bool = False


_TOKEN = re.compile(r'\s*(?:"((?:[^"]|"")*)"|([\w]+)|([()*+^:{},]))')


def parse(query: str) -> tuple:
    """A tree of ("and" | "or" | "not", left, right), ("near", phrases, distance) and phrases.

    Terms side by side must all match; AND, OR and NOT are operators, NOT binding most; "a b" and a + b are phrases, x*
    a prefix, ^x one that begins a column, c : x one within a column and {c d} : x within several; NEAR(a b, n) are phrases
    with n tokens between them at most, 10 if not said.
    """
    parts: list[tuple[str, str]] = []
    at = 0
    while query[at:].strip():
        m = _TOKEN.match(query, at)
        if not m:
            raise QuerySyntaxError(query)
        parts.append(("s", m[1].replace('""', '"')) if m[1] is not None else ("w", m[2]) if m[2] else ("p", m[3]))
        at = m.end()
    if not parts:
        raise QuerySyntaxError(query)
    i = 0

    def peek(k: int = 0) -> tuple[str, str]:
        return parts[i + k] if i + k < len(parts) else ("e", "")

    def take(*want: tuple[str, str]) -> bool:
        nonlocal i
        if peek() in want:
            i += 1
            return True
        return False

    def words(s: str) -> tuple[str, ...]:
        return tuple(re.findall(r"[^\W_]+", s.lower().translate(str.maketrans(ACCENTED, PLAIN))))

    def phrase(columns: tuple[str, ...] | None):
        nonlocal i
        first = take(("p", "^"))
        out: tuple[str, ...] = ()
        while True:
            kind, s = peek()
            if kind not in ("w", "s") or (kind == "w" and s in ("AND", "OR", "NOT")):
                raise QuerySyntaxError(query)
            i += 1
            out += words(s)
            if not take(("p", "+")):
                break
        return Phrase(out, take(("p", "*")), columns, first)

    def primary(columns: tuple[str, ...] | None = None):
        nonlocal i
        if take(("p", "(")):
            inner = either(columns)
            if not take(("p", ")")):
                raise QuerySyntaxError(query)
            return inner
        if take(("p", "{")):
            names = []
            while peek()[0] in ("w", "s"):
                names.append(peek()[1].lower())
                i += 1
            if not (take(("p", "}")) and take(("p", ":"))) or not set(names) <= set(COLUMNS):
                raise QuerySyntaxError(query)
            return primary(tuple(names))
        if peek()[0] in ("w", "s") and peek(1) == ("p", ":"):
            name = peek()[1].lower()
            if name not in COLUMNS:
                raise QuerySyntaxError(query)
            i += 2
            return primary((name,))
        if peek() == ("w", "NEAR") and peek(1) == ("p", "("):
            i += 2
            found = []
            while peek()[0] in ("w", "s"):
                found.append(phrase(columns))
            distance = 10
            if take(("p", ",")):
                if not peek()[1].isdecimal() or peek()[0] != "w":
                    raise QuerySyntaxError(query)
                distance = int(peek()[1])
                i += 1
            if not take(("p", ")")) or not found:
                raise QuerySyntaxError(query)
            return ("near", tuple(found), distance)
        return phrase(columns)

    def beside(columns):
        out = primary(columns)
        while peek()[0] in ("w", "s") and peek() not in (("w", "AND"), ("w", "OR"), ("w", "NOT")) or peek() in (("p", "("), ("p", "^"), ("p", "{")):
            out = ("and", out, primary(columns))
        return out

    def chain(word: str, below):
        def level(columns=None):
            out = below(columns)
            while take(("w", word)):
                out = (word.lower(), out, below(columns))
            return out

        return level

    either = chain("OR", chain("AND", chain("NOT", beside)))
    tree = either()
    if i < len(parts):
        raise QuerySyntaxError(query)
    return tree


def _phrases(tree) -> list[Phrase]:
    if isinstance(tree, Phrase):
        return [tree]
    if tree[0] == "near":
        return list(tree[1])
    return _phrases(tree[1]) + _phrases(tree[2])


def _occurrences(post: DataFrame, phrases: list[Phrase]) -> DataFrame:
    """id, tokens, col, phrase (its number), pos of each place where a phrase stands: one pass over the terms asked."""
    places = []
    for number, p in enumerate(phrases):
        for k, w in enumerate(p.words):
            fits = F.startswith("term", F.lit(w)) if p.prefix and k == len(p.words) - 1 else F.col("term") == w
            if p.columns is not None:
                fits = fits & F.col("col").isin(*p.columns)
            if p.first:
                fits = fits & (F.col("pos") == k)
            places.append((fits, number, k))
    if not places:
        return post.select("id", "tokens", "col", F.lit(0).alias("phrase"), "pos").limit(0)
    asked = places[0][0]
    for fits, _, _ in places[1:]:
        asked = asked | fits
    each = F.filter(F.array(*[F.when(fits, F.struct(F.lit(number).alias("phrase"), F.lit(k).alias("k"))) for fits, number, k in places]), lambda x: x.isNotNull())
    rows = post.where(asked).select("id", "tokens", "col", "pos", F.explode(each).alias("at"))
    if all(len(p.words) <= 1 for p in phrases):
        return rows.select("id", "tokens", "col", "at.phrase", "pos")
    size = F.get(F.array(*[F.lit(len(p.words)) for p in phrases]), F.col("phrase"))
    whole = rows.groupBy("id", "tokens", "col", F.col("at.phrase").alias("phrase"), (F.col("pos") - F.col("at.k")).alias("pos")).agg(F.count(F.lit(1)).alias("n"))
    return whole.where(F.col("n") == size).drop("n")


def _near(found: DataFrame, phrases: list[Phrase], numbers: list[int], distance: int) -> DataFrame:
    """id of the symbols in one of whose columns the phrases stand near one another."""
    own = lambda n: found.where(F.col("phrase") == n).select("id", "col", F.col("pos").alias("lo"), (F.col("pos") + len(phrases[n].words) - 1).alias("hi"))
    out = own(numbers[0])
    for n in numbers[1:]:
        both = out.join(own(n).select("id", "col", F.col("lo").alias("a"), F.col("hi").alias("b")), ["id", "col"])
        both = both.where((F.col("a") - F.col("hi") - 1 <= distance) & (F.col("lo") - F.col("b") - 1 <= distance))
        out = both.select("id", "col", F.least("lo", "a").alias("lo"), F.greatest("hi", "b").alias("hi"))
    return out.select("id").distinct()


def match(nodes: DataFrame, query: str, index: DataFrame | None = None) -> DataFrame:
    """id and rank of the symbols that match, the better the less. ``index``: stored rows of ``index_rows``.

    Each phrase's frequency counts once with the document frequency of the phrase; the statistics are of all symbols.
    Raises QuerySyntaxError where the query isn't in the grammar.
    """
    tree = parse(query)
    phrases = _phrases(tree)
    post = index_rows(nodes) if index is None else index
    found = _occurrences(post, phrases)
    times = [F.count_if(F.col("phrase") == k).alias(f"tf{k}") for k in range(len(phrases))]
    rows = found.groupBy("id").agg(F.max("tokens").alias("tokens"), *times)
    near: list[DataFrame] = []
    at = 0

    def matches(t) -> Column:
        nonlocal at
        if isinstance(t, Phrase):
            at += 1
            return F.col(f"tf{at - 1}") > 0
        if t[0] == "near":
            numbers = list(range(at, at + len(t[1])))
            at += len(t[1])
            near.append(_near(found, phrases, numbers, t[2]).withColumn(f"near{len(near)}", F.lit(True)))
            return F.coalesce(F.col(f"near{len(near) - 1}"), F.lit(False))
        left, right = matches(t[1]), matches(t[2])
        return left & right if t[0] == "and" else left | right if t[0] == "or" else left & ~right

    keep = matches(tree)
    counts = rows.agg(*[F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(phrases))])
    # symbols without a token count too
    symbols = nodes.agg(F.count(F.lit(1)).alias("docs"))
    length = post.agg(F.count(F.lit(1)).alias("all"))  # a row for each token
    for df in near:
        rows = rows.join(df, "id", "left")
    rows = rows.where(keep).crossJoin(F.broadcast(counts)).crossJoin(F.broadcast(symbols)).crossJoin(F.broadcast(length))
    mean = F.col("all") / F.col("docs")
    rank = F.lit(0.0)
    for k in range(len(phrases)):
        tf, df = F.col(f"tf{k}"), F.col(f"df{k}")
        idf = F.greatest(F.log((F.col("docs") - df + 0.5) / (df + 0.5)), F.lit(1e-6))
        rank = rank - F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("tokens") / mean))).otherwise(0.0)
    return rows.select("id", rank.alias("rank"))


def ladder(nodes: DataFrame, query: str, index: DataFrame | None = None, grams: DataFrame | None = None) -> DataFrame:
    """Symbols with rank: those that match, or else those of that name, or else those that contain the query.

    ``index`` and ``grams``: stored rows of this module's and of trigrams' ``index_rows``.
    """
    named = find_nodes(nodes, name=query).withColumn("rank", F.lit(0.0))
    like = (find_like(nodes, query) if grams is None else find_like_indexed(nodes, grams, query)).withColumn("rank", F.lit(0.0))
    try:
        matched = nodes.join(match(nodes, query, index), "id").select(*nodes.columns, "rank")
    except QuerySyntaxError:
        return first_found(named, like)
    return first_found(matched, named, like)


def relevance(query: str) -> list[Column]:
    """Sort keys: the name is the query, begins with it, contains it, or neither; shorter names; then the rest."""
    name, q = F.lower("name"), F.lit(query.lower())
    tier = F.when(name == q, 0).when(F.startswith(name, q), 1).when(F.contains(name, q), 2).otherwise(3)
    return [tier, F.octet_length("name"), F.col("name"), F.col("rank"), F.col("id")]


def search(nodes: DataFrame, query: str, limit: int = 30, no_tests: bool = False, index: DataFrame | None = None, grams: DataFrame | None = None) -> DataFrame:
    return without_tests(ladder(nodes, query, index, grams), no_tests).orderBy(*relevance(query)).limit(limit)


def more_than(nodes: DataFrame, query: str, limit: int = 30, no_tests: bool = False, index: DataFrame | None = None) -> DataFrame:
    """How many symbols ``search`` leaves out."""
    return without_tests(ladder(nodes, query, index), no_tests).agg(F.greatest(F.count(F.lit(1)) - limit, F.lit(0)).alias("more"))
