"""Secret scans with corpus-wide ownership frequency (operator 5). DataFrame functions only.

Base candidates come from three patterns. The method adds bare strings that mix upper case, lower case and digits:
every candidate value is hashed and its distinct repositories and owners are counted over the whole corpus. A bare
value of at most MAX_OWNERS owners and MAX_REPOSITORIES repositories that also looks random is live; a value beyond
either is a copied example. Base spans are listed whatever their verdict, but copied ones are not redacted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mixtide.llm._common import Tables, columns_of, documents, materialize, small_enough

#: The patterns of the base kinds, in the order in which kinds sort.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
#: The method's own candidates: long runs with a digit, an upper-case and a lower-case letter.
BARE = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "live")
MAX_OWNERS = 2
#: A fixed number, not a share: one owner may hold most of a corpus, and a credential is no more widely used for that.
MAX_REPOSITORIES = 20
#: Copied values (64 bytes each) up to which their list is broadcast.
BROADCAST_VALUES = 200_000
#: Characters of a text that are cut out of one piece; a text is cut into such pieces once.
PIECE = 2048
REDACTED = "[secret]"


def let(value: Column, body) -> Column:
    """body(x) with x bound to value once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, op) -> Column:
    """op over all integers in front of each element (0 in front of the first), then over all: one more than values.

    op is associative (a sum, a maximum). It runs inside blocks of about the root of the size, then over the blocks.
    """
    none = F.array().cast("array<int>")
    every = F.concat(values, F.array(F.lit(0)))
    step = lambda s, x: F.struct(op(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
    inside = lambda block: F.aggregate(block, F.struct(F.lit(0).alias("at"), none.alias("out")), step)

    def cut(v: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(v).cast("double"))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / width).cast("int")), lambda j: inside(F.slice(v, j * width + 1, width)))
        return let(blocks, lambda b: F.flatten(F.zip_with(b, inside(F.transform(b, lambda x: x["at"]))["out"], lambda x, past: F.transform(x["out"], lambda y: op(past, y)))))

    return let(every, cut)


def spans(text: Column, pattern: str, kind: int, wanted) -> Column:
    """Structs (start, kind, end, value) of a pattern's leftmost non-overlapping matches, in code points.

    The pieces between matches and the matches themselves, in turn, give every match its place.
    """
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")

    def placed(pairs: Column) -> Column:
        ends = running(F.transform(pairs, lambda x: F.length(x["p"]) + F.length(x["m"])), lambda a, b: a + b)
        span = lambda x, at: F.struct((at + F.length(x["p"])).alias("start"), F.lit(kind).alias("kind"), (at + F.length(x["p"]) + F.length(x["m"])).alias("end"), x["m"].alias("value"))
        return F.zip_with(pairs, F.slice(ends, 1, F.size(pairs)), span)

    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = let(matches, lambda found: F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(found)), found, lambda p, m: F.struct(p.alias("p"), m.alias("m"))))
    return F.when(text.rlike(pattern), F.filter(let(pairs, placed), lambda x: wanted(x["value"]))).otherwise(none)


def base_spans(text: Column) -> Column:
    value = lambda m: F.regexp_extract(m, ASSIGN, 2)
    assign = F.transform(spans(text, ASSIGN, 0, lambda m: F.length(value(m)) >= 8), lambda x: x)
    access = spans(text, ACCESS, 1, lambda m: F.length(m) >= 16)
    return F.array_sort(F.concat(assign, access, spans(text, HEX, 2, lambda m: F.lit(True))))


def bare_spans(text: Column) -> Column:
    return spans(text, BARE, 3, lambda m: m.rlike("[0-9]") & m.rlike("[a-z]") & m.rlike("[A-Z]"))


def value_of(x: Column) -> Column:
    """The secret inside a span: group 2 of an assignment, else all of it."""
    return F.when(x["kind"] == 0, F.regexp_extract(x["value"], ASSIGN, 2)).otherwise(x["value"])


def looks_random(value: Column) -> Column:
    """At least 8 different characters, and none of them fills more than half of the value."""
    letters = F.array_distinct(F.split(value, "(?!^)"))
    most = F.array_max(F.transform(letters, lambda c: F.length(value) - F.length(F.replace(value, c, F.lit("")))))
    return (F.size(letters) >= 8) & (most * 2 <= F.length(value))


def joined(x: Column) -> Column:
    """kind:start:end of spans in order, joined by commas."""
    name = lambda k: F.element_at(F.array(*[F.lit(n) for n in KINDS]), k + 1)
    return F.array_join(F.transform(x, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def ownership(candidates: DataFrame, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """(value_hash, repository, owner) -> value_hash, n_repositories, n_owners, live. Partial sums come before each shuffle."""
    by_repository = candidates.groupBy("value_hash", "repository", "owner").agg(F.count("*").alias("n"))
    counts = by_repository.groupBy("value_hash").agg(F.countDistinct("repository").alias("n_repositories"), F.countDistinct("owner").alias("n_owners"))
    return counts.withColumn("live", (F.col("n_owners") <= max_owners) & (F.col("n_repositories") <= max_repositories))


def _every_span(docs: DataFrame, owner: str, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """The rows of docs with their spans, and those spans one by one with value, value_hash and repository."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = F.coalesce(F.col(owner).cast("string"), F.lit("\x00"))
    one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), own.alias("owner"), F.xxhash64("text", F.lit(7)).alias("row_hash"), base_spans(text).alias("found"), bare_spans(text).alias("bare"))
    one = tables.write(one, "spans")
    held = one.withColumn("x", F.explode(F.concat("found", "bare"))).withColumn("value", value_of(F.col("x")))
    return one, held.withColumn("value_hash", F.sha2("value", 256)).withColumn("repository", F.coalesce("doc_id", "row_hash"))


def verdicts(docs: DataFrame, owner: str = "source", max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """(doc_id, text, owner) -> value_hash, n_repositories, n_owners, live of every base and bare value.

    Null doc_id: each text is a repository of its own; null owner: one owner; null text: no values; an empty table: no rows.
    """
    with Tables(docs.sparkSession) as tables:
        return materialize(ownership(_every_span(docs, owner, tables)[1].select("value_hash", "repository", "owner"), max_owners, max_repositories), "verdicts")


def scan(docs: DataFrame, owner: str = "source", max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """(doc_id, text, owner) -> one row per input row: row_hash, doc_id, found, live, copied.

    found: all base spans in order; live: the bare spans whose value is owner-specific; copied: the base spans whose
    value is a copied example. A document is a repository (a null doc_id: each text); a null owner counts as one owner
    of its own. Null text: no spans. Repeated rows give equal results. Columns besides doc_id, text and owner are ignored.
    """
    with Tables(docs.sparkSession) as tables:
        return materialize(_scan(docs, owner, max_owners, max_repositories, tables), "scanned")


def _scan(docs: DataFrame, owner: str, max_owners: int, max_repositories: int, tables: Tables) -> DataFrame:
    one, held = _every_span(docs, owner, tables)
    verdict = ownership(held.select("value_hash", "repository", "owner"), max_owners, max_repositories)
    examples = tables.write(verdict.filter(~F.col("live")).select("value_hash", F.lit(True).alias("example")), "examples")
    candidates = held.filter((F.col("x.kind") < 3) | looks_random(F.col("value")))
    met = candidates.join(small_enough(examples, BROADCAST_VALUES), "value_hash", "left").withColumn("example", F.coalesce("example", F.lit(False)))
    judged = met.filter((F.col("x.kind") < 3) == F.col("example"))  # base spans that are examples, bare ones that are not
    kept = lambda base: F.array_sort(F.collect_set(F.when((F.col("x.kind") < 3) == base, F.col("x"))))
    sides = judged.groupBy(F.col("doc_id").alias("id"), F.col("row_hash").alias("hash")).agg(kept(False).alias("live"), kept(True).alias("copied"))
    both = one.join(sides, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("row_hash") == F.col("hash")), "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    return both.select("row_hash", "doc_id", "found", F.coalesce("live", none).alias("live"), F.coalesce("copied", none).alias("copied"))


def all_spans(base: Column | str = "found") -> Column:
    """Base spans and live spans in order; a live span that a base span covers adds nothing."""
    base = F.col(base) if isinstance(base, str) else base

    def uncovered(every: Column) -> Column:
        past = running(F.transform(every, lambda x: F.when(x["kind"] < 3, x["end"]).otherwise(0)), lambda a, b: F.greatest(a, b))
        marked = F.zip_with(every, F.slice(past, 1, F.size(every)), lambda x, p: F.struct(x.alias("x"), ((x["kind"] < 3) | (p < x["end"])).alias("adds")))
        return F.transform(F.filter(marked, lambda m: m["adds"]), lambda m: m["x"])

    return let(F.array_sort(F.concat(base, F.col("live"))), uncovered)


def without(found: Column, copied: Column) -> Column:
    """found, in order, without the spans of copied, which are among them: in one sorted list those have an equal neighbour."""
    return let(F.array_sort(F.concat(found, copied)), lambda a: F.filter(a, lambda x, i: ~x.eqNullSafe(F.get(a, i + 1)) & ~x.eqNullSafe(F.get(a, i - 1))))


def _cut(pieces: Column, start: Column, end: Column) -> Column:
    """The characters start .. end of a text that pieces of PIECE characters hold."""
    first, last = F.floor(start / PIECE).cast("int"), F.floor((end - 1) / PIECE).cast("int")
    head = F.substring(F.get(pieces, first), F.pmod(start, F.lit(PIECE)) + 1, F.least(end - start, F.lit(PIECE)))
    between = F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    tail = F.when(last > first, F.concat(between, F.substring(F.get(pieces, last), F.lit(1), end - last * PIECE))).otherwise("")
    return F.when(end > start, F.concat(head, tail)).otherwise("")


def _replaced(text: Column, spans: Column) -> Column:
    """text with the value of each span (in order of start) replaced; a span that starts inside an earlier one adds nothing."""

    def build(pieces: Column) -> Column:
        past = running(F.transform(spans, lambda x: x["end"]), lambda a, b: F.greatest(a, b))  # where the text goes on
        name = lambda x: F.when(x["kind"] == 0, F.regexp_replace(x["value"], r"[A-Za-z0-9+/_.=-]+$", "")).otherwise("")
        part = lambda x, at: F.when(x["start"] >= at, F.concat(_cut(pieces, at, x["start"]), name(x), F.lit(REDACTED))).otherwise("")
        parts = let(past, lambda p: F.concat(F.zip_with(spans, F.slice(p, 1, F.size(spans)), part), F.array(_cut(pieces, F.element_at(p, -1), F.length(text)))))
        return F.array_join(parts, "")

    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), build)


def redact(docs: DataFrame, owner: str = "source") -> DataFrame:
    """docs with every secret's value replaced by REDACTED and n_chars, if there, set to the new length; rows and columns stay.

    Base values that are copied examples stay as they are. Null texts, texts without secrets and repeated rows stay; null
    doc_ids and owners are handled as in scan. An empty table stays empty.
    """
    spans = all_spans(without(F.col("found"), F.col("copied")))
    with Tables(docs.sparkSession) as tables:
        scanned = tables.write(_scan(docs, owner, MAX_OWNERS, MAX_REPOSITORIES, tables), "scanned")
        found = scanned.select(F.col("doc_id").alias("__id"), F.col("row_hash").alias("__hash"), spans.alias("__spans")).filter(F.size("__spans") > 0).dropDuplicates(["__id", "__hash"])
        found = materialize(found, "secrets")
    found = small_enough(found, BROADCAST_VALUES)
    met = docs.withColumn("__row", F.xxhash64("text", F.lit(7))).join(found, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__row") == F.col("__hash")), "left")
    out = met.withColumn("text", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(_replaced(F.col("text"), F.col("__spans"))))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(dict(docs.dtypes)["n_chars"])))
    return out.select(*columns_of(docs))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and live spans of all documents; nulls, ties and repeats as in scan."""
    kind = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    return scan(documents(spark, sf_dir)).select("doc_id", kind(0).alias("n_assign"), kind(1).alias("n_access"), kind(2).alias("n_hex"), F.sha2(joined(F.col("found")), 256).alias("base_sha256"), joined(all_spans()).alias("spans"))


_PLACED = """list_transform(range(1, len(m{k}) + 1), lambda i: struct_pack(
    "start" := cast(list_sum(list_transform(p{k}[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m{k}[1:i - 1], lambda x: length(x))), 0) as bigint),
    kind := {k}, value := m{k}[i]))"""
_SQL_ASSIGN = ASSIGN.replace("'", "''")

OP5_SQL = f"""
with t as (
  select doc_id, coalesce(source, chr(0)) as owner, md5(coalesce(text, chr(0))) as row_hash,
    {", ".join(f"regexp_split_to_array(coalesce(text, ''), '{p}') as p{k}, regexp_extract_all(coalesce(text, ''), '{p}') as m{k}" for k, p in enumerate((_SQL_ASSIGN, ACCESS, HEX, BARE)))} from documents
), s as (
  select doc_id, owner, row_hash,
    list_concat(list_concat(list_filter({_PLACED.format(k=0)}, lambda x: length(regexp_extract(x.value, '{_SQL_ASSIGN}', 2)) >= 8),
      list_filter({_PLACED.format(k=1)}, lambda x: length(x.value) >= 16)), {_PLACED.format(k=2)}) as found,
    list_filter({_PLACED.format(k=3)}, lambda x: regexp_matches(x.value, '[0-9]') and regexp_matches(x.value, '[a-z]') and regexp_matches(x.value, '[A-Z]')) as bare from t
), h as (
  select doc_id, owner, row_hash, unnest(list_concat(found, bare)) as x from s
), v as (
  select *, case when x.kind = 0 then regexp_extract(x.value, '{_SQL_ASSIGN}', 2) else x.value end as value from h
), own as (select value, count(distinct owner) as owners, count(distinct coalesce(cast(doc_id as varchar), row_hash)) as repositories from v group by 1
), live as (
  select distinct doc_id, row_hash, x from v join own using (value) where x.kind = 3 and owners <= {MAX_OWNERS} and repositories <= {MAX_REPOSITORIES}
    and len(list_distinct(string_split(value, ''))) >= 8
    and list_max(list_transform(list_distinct(string_split(value, '')), lambda c: length(value) - length(replace(value, c, '')))) * 2 <= length(value)
), e as (
  select s.doc_id, s.row_hash, y, y."start" + length(y.value) as fin from (select doc_id, row_hash, unnest(found) as y from s) s
), extra as (
  select doc_id, row_hash, x from live l where not exists (
    select 1 from e where e.doc_id = l.doc_id and e.row_hash = l.row_hash and e.y."start" <= l.x."start" and e.fin >= l.x."start" + length(l.x.value))
), every as (
  select distinct doc_id, row_hash, y as x from e union all select * from extra
), named as (
  select doc_id, row_hash, x.kind as kind, x."start" as a, ['assign', 'access', 'hex', 'live'][x.kind + 1] || ':' || x."start" || ':' || (x."start" + length(x.value)) as name from every
), g as (
  select doc_id, row_hash, string_agg(name, ',' order by a, kind) as spans, coalesce(string_agg(name, ',' order by a, kind) filter (kind < 3), '') as base,
    count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex from named group by 1, 2
)
select s.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from s left join g on s.doc_id = g.doc_id and s.row_hash = g.row_hash
"""
