"""Secret scans with multipart credential linking (DataFrame functions only).

Strong secrets are found by their own form. Weak candidates (an account name, a long random string, an endpoint) look
like much ordinary text; they are reported only where a complementary part lies within SCOPE code points of them in
the same document. That test is an interval join: both sides are dealt into position buckets of SCOPE code points, so
a bucket holds no more parts than fit into its text, whatever the document's length.

Defined results: null texts count as empty; null ids are kept; repeated rows get the same spans each; a document
without spans has empty strings and the digest of the empty string; an empty table gives no rows; extra columns are
ignored; spans with equal starts stand in the order of KINDS.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planlens.llm.common import let, text_of, written

# Fixed patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Weak candidates: account names set to a value, temporary key ids, long mixed strings, endpoints.
WEAK = (
    r"""(?<![A-Za-z0-9_])(?i:client_?id|access_?key_?id|account|user(?:name)?|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}"""
    r"|ASIA[A-Z0-9]{16,}"
    r"|(?:https?|ftp|postgres|postgresql|mysql|redis|amqp|mongodb)://[A-Za-z0-9_.:@/?=&%-]{4,}"
    r"|(?i:host|server|endpoint)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_.:-]{4,}"
    r"|(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{32,}={0,2}"
)
#: Order of kinds among spans with one start; the last three are weak.
KINDS = ("assign", "access", "hex", "id", "secret", "endpoint")
BASE = KINDS[:3]
#: The part of a credential that each kind stands for.
ROLE = {"assign": "secret", "access": "id", "hex": "secret", "id": "id", "secret": "secret", "endpoint": "endpoint"}
#: Largest gap, in code points, between the complementary parts of a credential.
SCOPE = 200
#: Elements, and code points, that are handled together.
CHUNK, PIECE = 256, 4096

_SPAN = "struct<start:int,rank:int,end:int,kind:string>"


def running(values: Column, merge, first: int = 0) -> Column:
    """merge of all elements up to and with each; in chunks, so that long arrays don't cost their length squared."""
    none = F.array().cast("array<int>")
    end = lambda a: F.coalesce(F.get(a, F.size(a) - 1), F.lit(first))
    within = lambda c: F.aggregate(c, none, lambda a, x: F.concat(a, F.array(merge(end(a), x))))

    def of(v: Column) -> Column:
        n_chunks = F.ceil(F.size(v) / F.lit(CHUNK)).cast("int")
        chunks = F.transform(F.sequence(F.lit(0), F.greatest(n_chunks, F.lit(1)) - 1), lambda k: within(F.slice(v, k * CHUNK + 1, CHUNK)))
        return let(chunks, lambda cs: let(within(F.transform(cs, end)), lambda ends: F.flatten(
            F.transform(cs, lambda c, k: F.transform(c, lambda x: merge(x, F.coalesce(F.get(ends, k - 1), F.lit(first))))))))

    return F.when(F.size(values) == 0, none).otherwise(let(values, of))


def running_sums(values: Column) -> Column:
    return running(values, lambda a, b: a + b)


def _found(text: Column, pattern: str, made) -> Column:
    """Spans of leftmost non-overlapping matches: what lies between matches gives the places. made(start, match, k)."""
    between, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(m: Column) -> Column:
        gaps = F.zip_with(between, m, lambda b, x: F.length(b) + F.coalesce(F.length(x), F.lit(0)))
        return let(running_sums(F.slice(gaps, 1, F.size(m))), lambda ends: F.transform(m, lambda x, k: made(F.get(ends, k) - F.length(x), x, k)))

    return let(matches, placed)


def _span(start: Column, match: Column, kind: Column) -> Column:
    rank = F.array_position(F.array(*map(F.lit, KINDS)), kind).cast("int")
    return F.struct(start.cast("int").alias("start"), rank.alias("rank"), (start + F.length(match)).cast("int").alias("end"), kind.alias("kind"))


def _weak_kind(m: Column) -> Column:
    return (
        F.when(m.rlike(r"^(?:ASIA[A-Z0-9]{16,}$|(?i:client_?id|access_?key_?id|account|user(?:name)?|login)[\"']?\x20*[:=])"), F.lit("id"))
        .when(m.rlike(r"^(?:(?:https?|ftp|postgres|postgresql|mysql|redis|amqp|mongodb)://|(?i:host|server|endpoint)[\"']?\x20*[:=])"), F.lit("endpoint"))
        .otherwise(F.lit("secret"))
    )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text_key, base and weak spans (arrays), from one pass over each whole text; nothing is shuffled."""
    none = F.array().cast(f"array<{_SPAN}>")
    text = F.col("_text")
    if_any = lambda p, spans: F.when(text.rlike(p), spans).otherwise(none)
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    assign = let(values, lambda v: F.filter(
        _found(text, ASSIGN, lambda s, m, k: F.when(F.length(F.get(v, k)) >= 6, _span(s, m, F.lit("assign")))), lambda x: x.isNotNull()))
    plain = lambda p, kind: _found(text, p, lambda s, m, _: _span(s, m, F.lit(kind)))
    d = docs.select(F.col(id_col), text_of(text_col).alias("_text"))
    return d.select(
        id_col,
        F.struct(F.xxhash64("_text").alias("h"), F.length("_text").alias("n")).alias("text_key"),
        F.concat(if_any(ASSIGN, assign), if_any(ACCESS, plain(ACCESS, "access")), if_any(HEX, plain(HEX, "hex"))).cast(f"array<{_SPAN}>").alias("base"),
        if_any(WEAK, _found(text, WEAK, lambda s, m, _: _span(s, m, _weak_kind(m)))).cast(f"array<{_SPAN}>").alias("weak"),
    )


def link(scanned: DataFrame, scope: int = SCOPE, id_col: str = "doc_id") -> DataFrame:
    """id, text_key and linked: the weak spans that have a complementary part within scope and lie in no base span."""
    key = [F.col(id_col).alias("_id"), F.col("text_key").alias("_key")]
    role = F.element_at(F.create_map(*(F.lit(x) for kv in ROLE.items() for x in kv)), F.col("s.kind"))
    busy = scanned.where((F.size("weak") > 0) & (F.size("base") + F.size("weak") > 1))
    bucket = lambda a, b: F.explode(F.sequence(F.floor(a / scope).cast("int"), F.floor(b / scope).cast("int")))
    weak = busy.select(*key, F.explode("weak").alias("s"))
    weak = weak.select("_id", "_key", "s", role.alias("role"), bucket(F.greatest(F.col("s.start") - scope, F.lit(0)), F.col("s.end") + scope).alias("at"))
    parts = busy.select(*key, F.explode(F.concat("base", "weak")).alias("s"))
    parts = parts.select(F.col("_id").alias("p_id"), F.col("_key").alias("p_key"), F.col("s").alias("p"), role.alias("p_role"),
                         bucket(F.col("s.start"), F.greatest(F.col("s.end") - 1, F.col("s.start"))).alias("p_at")).distinct()
    near = (F.col("p.start") <= F.col("s.end") + scope) & (F.col("s.start") <= F.col("p.end") + scope)
    on = F.col("_id").eqNullSafe(F.col("p_id")) & (F.col("_key") == F.col("p_key")) & (F.col("at") == F.col("p_at")) & (F.col("role") != F.col("p_role")) & near
    linked = weak.join(parts, on, "left_semi").select("_id", "_key", "s").distinct()
    # A weak span inside a base span is that secret's own text.
    linked = linked.withColumn("at", F.floor(F.col("s.start") / scope).cast("int"))
    base = parts.where(F.col("p.kind").isin(*BASE))
    inside = F.col("_id").eqNullSafe(F.col("p_id")) & (F.col("_key") == F.col("p_key")) & (F.col("at") == F.col("p_at")) & (F.col("p.start") <= F.col("s.start")) & (F.col("s.end") <= F.col("p.end"))
    return linked.join(base, inside, "left_anti").groupBy("_id", "_key").agg(F.collect_list("s").alias("linked"))


def find_secrets(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, base and linked spans of every row. Only spans are written and shuffled, never texts."""
    scanned = written(scan(docs, id_col, text_col))
    on = F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))
    both = scanned.join(link(scanned, scope, id_col), on, "left")
    return both.select(id_col, "text_key", "base", F.coalesce("linked", F.array().cast(f"array<{_SPAN}>")).alias("linked"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined, by start and then by the order of KINDS."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op7(docs: DataFrame) -> DataFrame:
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return find_secrets(docs).select(
        "doc_id", n("assign"), n("access"), n("hex"),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "linked")).alias("spans"),
    )


def redact(text: Column, spans: Column, by: str = "[SECRET]") -> Column:
    """The text with each span, overlapping ones merged, replaced by a mark.

    The text is cut into pieces of PIECE code points once, so that no part of it is sought from its start.
    """

    def built(pieces: Column, s: Column) -> Column:
        def between(a: Column, z: Column) -> Column:
            i, j = F.floor(a / PIECE).cast("int"), F.floor(z / PIECE).cast("int")
            piece = lambda k: F.coalesce(F.get(pieces, k), F.lit(""))
            over = F.concat(F.substring(piece(i), a % PIECE + 1, F.lit(PIECE)), F.array_join(F.slice(pieces, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(piece(j), F.lit(1), z % PIECE))
            return F.when(i == j, F.substring(piece(i), a % PIECE + 1, z - a)).otherwise(over)

        def filled(ends: Column) -> Column:
            before = lambda k: F.coalesce(F.get(ends, k - 1), F.lit(0))
            marked = F.transform(s, lambda x, k: F.when(x["start"] >= before(k), F.concat(between(before(k), x["start"]), F.lit(by))).otherwise(F.lit("")))
            return F.concat(F.array_join(marked, ""), between(F.get(ends, F.size(ends) - 1), F.length(text)))

        return let(running(F.transform(s, lambda x: x["end"]), lambda a, b: F.greatest(a, b)), filled)

    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    return F.when(F.size(spans) == 0, text).otherwise(let(cut, lambda pieces: let(F.array_sort(spans), lambda s: built(pieces, s))))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, the secrets in their texts replaced by a mark; a null text stays null."""
    found = find_secrets(docs).where((F.size("base") > 0) | (F.size("linked") > 0))
    spans = found.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.concat("base", "linked").alias("_spans")).dropDuplicates(["_id", "_key"])
    key = F.struct(F.xxhash64(text_of()).alias("h"), F.length(text_of()).alias("n"))
    d = docs.select(F.struct(*docs.columns).alias("doc"), key.alias("key"))
    d = d.join(spans, F.col("doc.doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    clean = F.col("_spans").isNull()
    d = d.select("doc", clean.alias("clean"), F.when(clean, F.col("doc.text")).otherwise(redact(F.col("doc.text"), F.col("_spans"))).alias("new"))
    now = {"text": F.col("new"), "n_chars": F.when(F.col("clean"), F.col("doc.n_chars") if "n_chars" in docs.columns else F.lit(None)).otherwise(F.length("new").cast("long"))}
    return d.select(*[now.get(c, F.col("doc")[c]).alias(c) for c in docs.columns])
