"""Call resolution: which symbols the call sites of a project name.

Stages are tried in turn, from the most certain; a stage decides if it leaves one candidate. What decides a call at a
stage is a few strings, so each stage is an index: of the combinations that have exactly one candidate, and that
candidate. Most indexes are made of the symbols alone, so a name that thousands of symbols share is a few rows there.
Where substrings count, the distinct strings that calls ask for meet the symbols that have a segment of the path, or as
many last characters, in common. Each call then looks its strings up in every index, and the first hit stands: joins on
equality whose smaller side Spark sends around where it is small, and whose hot keys it splits where not.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.functions.columns import callee_namespace, owner_of, path_matches_hint, simple_name
from callweave.plans.cut import cut

EXACT, RECEIVER, PACKAGE, NAMESPACE, SAME_FILE, NAME_ONLY = 5, 4, 3, 2, 1, 0


def symbols(nodes: DataFrame) -> DataFrame:
    """id, name, file_path, qname, namespace, owner, exact_owner, of every node."""
    own = F.substring(F.col("id"), F.length("file_path") + F.lit(3), F.length("id"))
    qname = F.coalesce("qualified_name", F.when(F.startswith("id", F.concat("file_path", F.lit("::"))), own).otherwise(F.col("id")))
    out = nodes.select("id", "name", "file_path", "qualified_name", qname.alias("qname"))
    suffix = F.concat(F.lit("::"), F.col("name"))
    exact = F.when(F.endswith("qname", suffix), F.substring(F.col("qname"), F.lit(1), F.length("qname") - F.length(suffix)))
    namespace = F.when(F.col("qualified_name").isNotNull(), callee_namespace(F.col("qname")))
    return out.select("id", "name", "file_path", "qname", namespace.alias("namespace"), owner_of(F.col("qname")).alias("owner"), exact.alias("exact_owner"))


def only(rows: DataFrame, *keys: str) -> DataFrame:
    """The keys that exactly one row has, and its id."""
    return rows.dropna(subset=list(keys)).groupBy(*keys).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")


def asked(calls: DataFrame) -> DataFrame:
    """The calls with what their names say."""
    return calls.withColumns({"simple": simple_name(F.col("callee_name")), "ns": callee_namespace(F.col("callee_name"))})


def _segments(path: Column, sep: str) -> Column:
    """The parts of a path between separators, as one string."""
    return F.array_join(F.split(path, sep), "\1")


def _tails(owner: Column) -> Column:
    """The owner, and what is left of it without its first segments."""
    parts = F.split(owner, "::")
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "::")))


#: What a stage finds: the candidates and how sure they are.
TARGETS = "array<struct<id:string,kind:int>>"


@dataclass(frozen=True)
class Index:
    """rows: a column for each of ``on``, and targets. ``on``: what a call looks up there; it finds nothing by a null."""

    rows: DataFrame
    on: dict[str, Column]


def _index(rows: DataFrame, on: dict[str, Column], kind: Column | int) -> Index:
    kind = kind if isinstance(kind, Column) else F.lit(kind)
    return Index(rows.select(*on, F.array(F.struct(F.col("id"), kind.alias("kind"))).cast(TARGETS).alias("targets")), on)


def stage_exact(calls: DataFrame, syms: DataFrame) -> Index:
    """The import hint's dotted segments are those of the candidate's owner."""
    rows = only(syms.select("id", "name", _segments(F.col("exact_owner"), "::").alias("segments")), "name", "segments")
    return _index(rows, {"name": F.col("simple"), "segments": _segments(F.col("import_hint"), r"\.")}, EXACT)


def stage_receiver(calls: DataFrame, syms: DataFrame) -> Index:
    """The receiver's type is the owner or ends it; a candidate in a path that the import hint names is exact."""
    by_tail = syms.where("owner is not null").select("id", "name", "file_path", F.explode(_tails(F.col("owner"))).alias("receiver_type"))
    wanted = calls.where("receiver_type is not null").select(F.col("simple").alias("name"), "receiver_type", "import_hint").distinct()
    found = wanted.join(by_tail, ["name", "receiver_type"])
    kind = F.when(F.col("import_hint").isNotNull() & path_matches_hint(F.col("file_path"), F.col("import_hint")), EXACT).otherwise(RECEIVER)
    hint = F.coalesce("import_hint", F.lit("\0"))
    best = found.groupBy("name", "receiver_type", hint.alias("hint"), kind.alias("kind")).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    best = best.groupBy("name", "receiver_type", "hint").agg(F.max(F.struct("kind", "n", "id")).alias("best")).where("best.n = 1")
    rows = best.select("name", "receiver_type", "hint", "best.id", F.col("best.kind").alias("found"))
    return _index(rows, {"name": F.col("simple"), "receiver_type": F.col("receiver_type"), "hint": hint}, F.col("found"))


def stage_import(calls: DataFrame, syms: DataFrame) -> Index:
    """The candidate's file is in a path that the import hint names.

    What stands between two separators of a hint is a whole segment of such a path, so candidates meet hints of three
    segments or more by the longest of these, and others by name.
    """
    pairs = calls.where("import_hint is not null").select(F.col("simple").alias("name"), "import_hint").distinct()
    parts = F.split("import_hint", r"[./\\]", -1)
    inner = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))
    pairs = pairs.withColumn("segment", F.array_max(F.transform(inner, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"])
    own = syms.select("id", "name", "file_path")
    by_segment = own.withColumn("segment", F.explode(F.array_distinct(F.split("file_path", r"[./\\]", -1))))
    found = pairs.where("segment is not null").join(by_segment, ["name", "segment"]).unionByName(pairs.where("segment is null").join(own, "name"))
    found = found.where(path_matches_hint(F.col("file_path"), F.col("import_hint")))
    return _index(only(found, "name", "import_hint"), {"name": F.col("simple"), "import_hint": F.col("import_hint")}, PACKAGE)


def stage_package(calls: DataFrame, syms: DataFrame) -> Index:
    """The first segment of the candidate's qualified name is the call's package."""
    rows = only(syms.select("id", "name", F.substring_index("qname", "::", 1).alias("package")), "name", "package")
    return _index(rows, {"name": F.col("simple"), "package": F.col("package_or_namespace")}, PACKAGE)


def stage_scope(calls: DataFrame, syms: DataFrame) -> Index:
    """The candidate's qualified name ends with the call's last two segments, whatever stands before them.

    A name's candidates meet the few lengths of its calls' segments, and then the segments themselves.
    """
    lengths = calls.where("ns is not null").select(F.col("simple").alias("name"), F.length("ns").alias("n")).distinct()
    ends = syms.select("id", "name", "qname").join(lengths, "name").where(F.endswith("qname", F.concat(F.lit("::"), "name")))
    before = F.length("qname") - F.length("name") - 2
    rows = only(ends.where(before >= F.col("n")).select("id", "name", F.substring(F.col("qname"), before - F.col("n") + 1, F.col("n")).alias("ns")), "name", "ns")
    return _index(rows, {"name": F.col("simple"), "ns": F.col("ns")}, PACKAGE)


def stage_namespace(calls: DataFrame, syms: DataFrame) -> Index:
    """Caller and candidate are in the same namespace."""
    rows = only(syms.select("id", "name", "namespace"), "name", "namespace")
    return _index(rows, {"name": F.col("simple"), "namespace": F.col("caller_namespace")}, NAMESPACE)


def stage_same_file(calls: DataFrame, syms: DataFrame) -> Index:
    """Every candidate in the caller's file."""
    rows = syms.groupBy("name", "file_path").agg(F.collect_list(F.struct("id", F.lit(SAME_FILE).alias("kind"))).cast(TARGETS).alias("targets"))
    return Index(rows, {"name": F.col("simple"), "file_path": F.col("caller_file")})


def stage_name(calls: DataFrame, syms: DataFrame) -> Index:
    """The project's only candidate."""
    return _index(only(syms.select("id", "name"), "name"), {"name": F.col("simple")}, NAME_ONLY)


STAGES = {
    "exact": stage_exact, "receiver": stage_receiver, "imported": stage_import, "package": stage_package, "scope": stage_scope,
    "namespace_hit": stage_namespace, "same_file": stage_same_file, "named": stage_name,
}
#: What a call says of its target, and the stages that this alone decides.
SAID = ["callee_name", "receiver_type", "import_hint", "package_or_namespace"]
BY_WORDS = ["exact", "receiver", "imported", "package", "scope"]
#: Stages that ask for the caller's place too; names that they leave open have several candidates.
BY_PLACE = ["namespace_hit", "same_file"]


def look_up(calls: DataFrame, indexes: dict[str, Index]) -> DataFrame:
    """The calls, with what they find at each stage as ``__stage``."""
    for stage, index in indexes.items():
        keys = {k: f"__{stage}_{k}" for k in index.on}
        rows = index.rows.select(*[F.col(k).alias(name) for k, name in keys.items()], F.col("targets").alias(f"__{stage}"))
        calls = calls.join(rows, reduce(Column.__and__, [index.on[k] == F.col(name) for k, name in keys.items()]), "left").drop(*keys.values())
    return calls


def first_hit(stages: dict[str, Column]) -> Column:
    """The first of the stages whose column isn't null."""
    return F.coalesce(*[F.when(c.isNotNull(), F.lit(stage)) for stage, c in stages.items()])


def lone(syms: DataFrame) -> DataFrame:
    """The symbols that no other has the name of, in columns ``only_...``."""
    tails = F.when(F.col("owner").isNotNull(), _tails(F.col("owner")))
    about = F.struct("id", "file_path", "qname", "namespace", _segments(F.col("exact_owner"), "::").alias("segments"), tails.alias("tails"))
    rows = syms.where("name is not null").groupBy("name").agg(F.min(about).alias("only"), F.count(F.lit(1)).alias("n")).where("n = 1")
    return rows.select(F.col("name").alias("only_name"), *[F.col(f"only.{c}").alias(f"only_{c}") for c in ("id", "file_path", "qname", "namespace", "segments", "tails")])


def lone_kinds() -> dict[str, Column]:
    """By stage, the kind of a call's only candidate (``only_...``) if the stage takes it; these are the stages' conditions."""
    hinted = F.col("import_hint").isNotNull() & path_matches_hint(F.col("only_file_path"), F.col("import_hint"))
    fits = {
        "exact": (F.col("only_segments") == _segments(F.col("import_hint"), r"\."), F.lit(EXACT)),
        "receiver": (F.array_contains("only_tails", F.col("receiver_type")), F.when(hinted, EXACT).otherwise(RECEIVER)),
        "imported": (hinted, F.lit(PACKAGE)),
        "package": (F.substring_index("only_qname", "::", 1) == F.col("package_or_namespace"), F.lit(PACKAGE)),
        "scope": (F.endswith("only_qname", F.concat("ns", F.lit("::"), "only_name")), F.lit(PACKAGE)),
        "namespace_hit": (F.col("only_namespace") == F.col("caller_namespace"), F.lit(NAMESPACE)),
        "same_file": (F.col("only_file_path") == F.col("caller_file"), F.lit(SAME_FILE)),
        "named": (F.col("only_id").isNotNull(), F.lit(NAME_ONLY)),
    }
    return {stage: F.when(fit, kind) for stage, (fit, kind) in fits.items()}


def answers(calls: DataFrame, syms: DataFrame) -> DataFrame:
    """What calls say (SAID) of the names of ``syms``, each once, with said and said_stage where that decides."""
    asks = asked(calls.select(*SAID).distinct()).join(syms.select(F.col("name").alias("simple")).distinct(), "simple", "left_semi")
    asks = cut(asks)
    found = look_up(asks, {stage: STAGES[stage](asks, syms) for stage in BY_WORDS})
    hits = {stage: F.col(f"__{stage}") for stage in BY_WORDS}
    return found.select(*SAID, F.coalesce(*hits.values()).alias("said"), first_hit(hits).alias("said_stage")).where("said is not null")


def resolve(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """The calls, each with targets: array<struct<id, kind>>, empty if unresolved, and stage.

    Names that one symbol has are found by a single join, and the stages are conditions on what it finds. For the others
    what calls say is resolved once for each combination, and calls look that up as a whole. So a call moves a few times,
    however many stages there are. ``calls`` are read twice.
    """
    syms = cut(symbols(nodes))
    single = cut(lone(syms))
    shared = cut(syms.where("name is not null").join(single.select(F.col("only_name").alias("name")), "name", "left_anti"))
    words = cut(answers(calls, shared)).select(*[F.col(c).alias(f"__{c}") for c in SAID], "said", "said_stage")
    out = asked(calls).join(single, F.col("simple") == F.col("only_name"), "left")
    out = out.join(words, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in SAID]), "left")
    callers = syms.select(F.col("id").alias("caller_id"), F.col("namespace").alias("caller_namespace"), F.col("file_path").alias("caller_file"))
    out = out.join(callers, "caller_id", "left")
    own = lone_kinds()
    out = out.withColumns({"only_kind": F.coalesce(*own.values()), "only_stage": first_hit(own)})
    out = look_up(out, {stage: STAGES[stage](calls, shared) for stage in BY_PLACE})
    places = {stage: F.col(f"__{stage}") for stage in BY_PLACE}
    only = F.when(F.col("only_id").isNotNull(), F.array(F.struct(F.col("only_id").alias("id"), F.col("only_kind").alias("kind"))).cast(TARGETS))
    targets = F.coalesce(only, F.col("said"), *places.values(), F.array().cast(TARGETS))
    stage = F.coalesce("only_stage", "said_stage", first_hit(places), F.lit("unresolved"))
    return out.select(*[c for c in calls.columns], targets.alias("targets"), stage.alias("stage"))


def resolve_in_file(calls: DataFrame, nodes: DataFrame, file_path: str) -> DataFrame:
    """The same within a single file: its calls, and its symbols alone as candidates."""
    own = nodes.where(F.col("file_path") == file_path)
    return resolve(calls.join(own.select(F.col("id").alias("caller_id")), "caller_id", "left_semi"), own)


#: What ``edges_of`` and ``unresolved_of`` read: a stored result needs no more.
FOUND = ["caller_id", "callee_name", "line", "column", "targets"]


def edges_of(resolved: DataFrame) -> DataFrame:
    """One edge for each caller and target, of the surest kind."""
    each = resolved.select(F.col("caller_id").alias("source_id"), F.explode("targets").alias("t"))
    return each.groupBy("source_id", F.col("t.id").alias("target_id"), F.lit("calls").alias("kind")).agg(F.max("t.kind").alias("resolution_kind"))


def unresolved_of(resolved: DataFrame) -> DataFrame:
    """A row for each call without a target."""
    return resolved.where(F.size("targets") == 0).select(F.col("caller_id").alias("source_id"), F.col("callee_name").alias("specifier"), F.lit("calls").alias("kind"), "line", "column")
