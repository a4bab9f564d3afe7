"""Secret scans with an incremental blob ledger (DataFrame functions only).

Every version of a text is addressed by the SHA-256 of its content. The ledger
records which (blob, rule, rule version) triples have been scanned and what
was found. A scan reads the text of unseen triples only, once per blob however
many paths carry it, appends to the ledger, and joins the findings back to
all paths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from horizonkit.llm.common import fresh_folder, keyed_text, unused_column


@dataclass(frozen=True)
class Rule:
    """A pattern whose leftmost non-overlapping matches are kept if long enough.

    ``guard`` is a cheaper pattern that every text with a kept match contains;
    ``measured`` is the group whose length must reach ``least``.
    """

    kind: str
    version: int
    pattern: str
    guard: str
    measured: int = 0
    least: int = 1


# Private keys: the lines that begin and end one, and what a line of a key without an END line looks like:
# quote marks or list dashes, then a header, base64 letters (16 or more, or padded), or nothing.
PEM_BEGIN = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
PEM_END = r"-----END [A-Z ]{0,40}PRIVATE KEY-----"
PEM_LINE = (
    r"^[ \t\r>|*#.\x22'-]{0,16}(?:(?:Proc-Type|DEK-Info|Comment|Version): .*"
    r"|[A-Za-z0-9+/]{16,}={0,2}|[A-Za-z0-9+/]{1,15}={1,2}|)[ \t\r\x22',]*$"
)
#: Base64 letters at the start of a line that goes on with other text.
PEM_LAST = r"^([ \t\r>|*#.\x22'-]{0,16}(?:[A-Za-z0-9+/]{16,}={0,2}|[A-Za-z0-9+/]{1,15}={1,2}))(?:[^A-Za-z0-9+/=]|$)"

# The base kinds in their order, then the added one.
RULES = (
    Rule(
        "assign", 1,
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]""", 2, 6,
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]{16}", 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}", r"[0-9a-f]{24}"),  # a run is one match, so the bound can be in it
    Rule("pem", 3, PEM_BEGIN, r"PRIVATE KEY-----"),  # its spans reach over the key: see key_spans
)
BASE_KINDS = ("assign", "access", "hex")
SPANS = "array<struct<start:long,end:long>>"
LEDGER = f"blob string, rule string, version int, spans {SPANS}"


def key_body(after: Column) -> Column:
    """How many characters behind a BEGIN line belong to its key; ``after`` reaches to the next BEGIN line.

    All up to the END line where there is one. Else the lines that follow for as
    long as they look like a key's, up to the last one that is not blank; a
    written-out ``\\n`` or ``\\r`` ends a line too. No bound on lines or lengths.
    """
    closed = F.char_length(F.element_at(F.split(after, PEM_END, 2), 1)) + F.char_length(F.regexp_extract(after, PEM_END, 0))
    lines = F.split(F.regexp_replace(after, r"\\[nr]", " \n"), "\n", -1)
    other = F.array_position(F.transform(lines, lambda line: line.rlike(PEM_LINE)), False).cast("int")
    own = F.slice(lines, 1, F.when(other == 0, F.size(lines)).otherwise(other - 1))
    last = F.coalesce(F.array_max(F.transform(own, lambda line, i: F.when(line.rlike("[A-Za-z0-9+/=]"), i + 1))), F.lit(0))
    length = F.aggregate(F.slice(own, 1, last), F.lit(0), lambda n, line: n + F.char_length(line) + 1)
    # the line that ends the run may begin with the key's last letters
    rest = F.char_length(F.regexp_extract(F.get(lines, last), PEM_LAST, 1))
    rest = F.when((other > 0) & (last == F.size(own)), rest).otherwise(0)
    covered = F.when(rest > 0, length + rest).otherwise(F.greatest(length - 1, F.lit(0)))
    return F.when(after.rlike(PEM_END), closed).otherwise(covered)


def key_spans(text: Column) -> Column:
    """Spans of private keys with their bodies. The text is split at BEGIN lines, so each key is looked at once."""
    begins = F.regexp_extract_all(text, F.lit(PEM_BEGIN), F.lit(0))
    parts = F.split(text, PEM_BEGIN, -1)
    keys = F.arrays_zip(
        F.slice(parts, F.lit(1), F.size(begins)).alias("gap"), begins.alias("begin"),
        F.slice(parts, F.lit(2), F.size(begins)).alias("after"),
    )

    def step(state: Column, key: Column) -> Column:
        start = state["at"] + F.char_length(key["gap"])
        behind = start + F.char_length(key["begin"])
        span = F.struct(start.alias("start"), (behind + key_body(key["after"])).alias("end"))
        return F.struct(behind.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPANS).alias("spans"))
    return F.aggregate(keys, start, step, lambda s: s["spans"])


def match_spans(text: Column, rule: Rule) -> Column:
    """Spans of the rule's kept matches: code points from 0, end exclusive.

    The text between matches and the matches alternate, so running lengths
    give the positions.
    """
    if rule.pattern == PEM_BEGIN:
        return F.when(text.rlike(rule.guard), key_spans(text)).otherwise(F.array().cast(SPANS))
    pattern = F.lit(rule.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    measured = F.regexp_extract_all(text, pattern, F.lit(rule.measured)) if rule.measured else matches
    parts = F.arrays_zip(
        F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(matches)).alias("gap"),
        matches.alias("match"), measured.alias("measured"),
    )

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + F.char_length(part["gap"])
        end = start + F.char_length(part["match"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        long_enough = F.char_length(part["measured"]) >= rule.least
        return F.struct(
            end.alias("at"), F.when(long_enough, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans")
        )

    none = F.array().cast(SPANS)
    start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans"))
    return F.when(text.rlike(rule.guard), F.aggregate(parts, start, step, lambda s: s["spans"])).otherwise(none)


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's triples, each once; empty where none has been written yet."""
    if not _exists(spark, path):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(path).dropDuplicates(["blob", "rule", "version"])


def blob_of(text: Column) -> Column:
    """Content address of a text."""
    return F.sha2(text.cast("binary"), 256)


def update_ledger(texts: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> None:
    """Scan the unseen (blob, rule, version) triples of ``texts(text)`` and append them."""
    spark = texts.sparkSession
    wanted = {f"{r.kind}:{r.version}": r for r in rules}
    blobs = texts.select(blob_of(F.col("text")).alias("blob"), "text")
    unseen = blobs.groupBy("blob").agg(F.any_value("text").alias("text"))
    if _exists(spark, path):
        seen = (
            read_ledger(spark, path)
            .groupBy("blob").agg(F.collect_set(F.concat_ws(":", "rule", "version")).alias("seen"))
        )
        everything = F.array(*map(F.lit, wanted))
        unseen = (
            unseen.join(seen, "blob", "left")
            .withColumn("todo", F.array_except(everything, F.coalesce("seen", F.array().cast("array<string>"))))
            .where(F.size("todo") > 0)
        )
    else:
        unseen = unseen.withColumn("todo", F.array(*map(F.lit, wanted)))
    results = F.array(*[
        F.when(
            F.array_contains("todo", name),
            F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"),
                     match_spans(F.col("text"), r).alias("spans")),
        )
        for name, r in wanted.items()
    ])
    found = unseen.select("blob", F.explode(F.filter(results, lambda x: x.isNotNull())).alias("r"))
    found.select("blob", "r.rule", "r.version", "r.spans").write.mode("append").parquet(path)


def findings(spark: SparkSession, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(blob, found)`` of the blobs where the given rule versions found something.

    ``found`` is sorted by start, then the rules' order.
    """
    rank = F.coalesce(*[
        F.when((F.col("rule") == r.kind) & (F.col("version") == r.version), F.lit(i)) for i, r in enumerate(rules)
    ])
    hits = (
        read_ledger(spark, path)
        .withColumn("rank", rank)
        .where(F.col("rank").isNotNull() & (F.size("spans") > 0))
        .select("blob", F.transform("spans", lambda s: F.struct(
            s["start"].alias("start"), F.col("rank").alias("rank"), s["end"].alias("end"), F.col("rule").alias("kind")
        )).alias("part"))
    )
    return hits.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("part"))).alias("found"))


FOUND = "array<struct<start:long,rank:int,end:long,kind:string>>"


def scan(docs: DataFrame, ledger_path: str | None = None, rules: tuple[Rule, ...] = RULES,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, found)`` per row; ``ledger_path`` defaults to a new ledger.

    Null and empty texts share the empty blob and find nothing. Repeated rows
    and null ids keep one result row each. An empty table gives no rows.
    """
    spark = docs.sparkSession
    path = ledger_path or fresh_folder(spark, "secret-ledger")
    versions = keyed_text(docs, id_col, text_col)
    update_ledger(versions, path, rules)
    paths = versions.select("doc_id", blob_of(F.col("text")).alias("blob"))
    joined = paths.join(findings(spark, path, rules), "blob", "left")
    return joined.select("doc_id", F.coalesce("found", F.array().cast(FOUND)).alias("found"))


def span_text(found: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(
        F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def redact(docs: DataFrame, ledger_path: str | None = None, rules: tuple[Rule, ...] = RULES,
           marker: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by ``marker``.

    Overlapping spans become one marker; ``n_chars`` follows where present.
    Texts without findings, null texts included, stay as they are; an empty
    table stays empty. Columns of ``docs`` may have any names.
    """
    spark = docs.sparkSession
    path = ledger_path or fresh_folder(spark, "secret-ledger")
    update_ledger(keyed_text(docs), path, rules)
    blob, held = unused_column(docs, "blob"), unused_column(docs, "found")
    found = findings(spark, path, rules).select(F.col("blob").alias(blob), F.col("found").alias(held))
    text = F.col("text")

    def step(state: Column, span: Column) -> Column:
        apart = span["start"] >= state["at"]
        gap = F.substr(text, state["at"].cast("int") + 1, (span["start"] - state["at"]).cast("int"))
        return F.struct(
            F.greatest(state["at"], span["end"]).alias("at"),
            F.when(apart, F.concat(state["out"], gap, F.lit(marker))).otherwise(state["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    clean = F.aggregate(
        F.col(held), start, step,
        lambda s: F.concat(s["out"], F.substr(text, s["at"].cast("int") + 1)),
    )
    joined = docs.withColumn(blob, blob_of(text)).join(found, blob, "left")
    changed = joined.withColumn("text", F.when(F.col(held).isNull(), text).otherwise(clean))
    if "n_chars" in docs.columns:
        changed = changed.withColumn(
            "n_chars", F.when(F.col(held).isNull(), F.col("n_chars"))
            .otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType)
        )
    return changed.select(*docs.columns)
