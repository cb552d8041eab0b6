"""Secret scans with multipart credential linking, in DataFrame functions only.

Base findings are the matches of three patterns. Beyond them, parts of a credential that
mean little alone (account identifiers, secret-like strings, endpoints) are weak
candidates: each is reported only when the parts that complete it lie in its scope, the
``SCOPE`` code points around it. That interval join runs inside the row over the
document's own spans, so no row moves and a long text costs only itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base patterns. Group 2 of ``assign`` is the value.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24
#: A maximal run shorter than the least length is dropped anyway, so only long runs are matched.
ACCESS_LONG = r"AKIA[A-Z0-9]{16,}"
HEX_LONG = r"[0-9a-f]{24,}"

#: Weak candidates: named identifiers, secret-like strings (three kinds of characters, 24 or more), endpoints.
WEAK_ID = r"""(?i:(?:access|account|client|tenant|user)[_-]?(?:key[_-]?)?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{4,}"""
WEAK_SECRET = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[A-Z0-9+/_=-]*[a-z])(?=[a-z0-9+/_=-]*[A-Z])[A-Za-z0-9+/_-]{24,}={0,2}"
WEAK_ENDPOINT = r"""(?i:https?|s3|jdbc:[a-z0-9]+|mongodb|postgres(?:ql)?|mysql|redis|amqp|ftp)://[^\s"'<>]+"""
#: Code points around a span in which its complements count.
SCOPE = 200
#: In the order in which spans of the same start are listed.
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
#: What a found secret is replaced by.
MASK = "[SECRET]"

_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _spans(text: Column, pattern: str, kind: int, value_group: int | None = None) -> Column:
    """Leftmost non-overlapping matches as (start, kind, end) in code points; with ``value_group``, only if it has 6 or more.

    The text between matches (``split``) and the matches themselves alternate, so running
    sums of their lengths give the positions.
    """
    p = F.lit(pattern)
    between = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, p, F.lit(0))
    values = F.regexp_extract_all(text, p, F.lit(value_group if value_group is not None else 0))
    steps = F.zip_with(F.slice(between, F.lit(1), F.size(matches)), F.arrays_zip(matches.alias("m"), values.alias("v")), lambda gap,
        x: F.struct(F.length(gap).alias("gap"), F.length(x["m"]).alias("m"), F.length(x["v"]).alias("v")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), (begin + x["m"]).alias("end"))
        keep = x["v"] >= MIN_VALUE if value_group is not None else F.lit(True)
        return F.struct((begin + x["m"]).alias("at"), F.when(keep, F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
            .alias("out"))

    found = F.aggregate(steps, start, step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(_SPAN))


def _near(a: Column, b: Column) -> Column:
    """Two spans of one scope."""
    return (a["start"] < b["end"] + SCOPE) & (b["start"] < a["end"] + SCOPE)


def _overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def with_spans(docs: DataFrame, text: str = "text", base: str = "base", spans: str = "spans") -> DataFrame:
    """``docs`` with columns ``base`` and ``spans``: arrays of (start, kind, end), sorted; earlier columns of those names are replaced.

    A null or empty text has none. Rules for weak candidates, none of which may overlap a
    base finding: a secret-like string needs an identifier (access or named) in its scope; a
    named identifier needs a secret (assign, hex or a reported secret-like string) in its
    scope; an endpoint needs both.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast(_SPAN)
    df = docs.withColumn("__assign", _spans(whole, ASSIGN, 0, 2)).withColumn("__access",
        _spans(whole, ACCESS_LONG, 1)).withColumn("__hex", _spans(whole, HEX_LONG, 2))
    df = df.withColumn(base, F.array_sort(F.concat("__assign", "__access", "__hex")))
    # No weak part is reported without an identifier near it, so texts without one are not searched further.
    named = whole.rlike(WEAK_ID)
    linked = (F.size("__access") > 0) | named
    fresh = lambda found: F.filter(found, lambda w: ~F.exists(base, lambda b: _overlap(w, b)))
    df = df.withColumn("__id", F.when(named, fresh(_spans(whole, WEAK_ID, 3))).otherwise(none))
    df = df.withColumn("__secret", F.when(linked, fresh(_spans(whole, WEAK_SECRET, 4))).otherwise(none))
    df = df.withColumn("__end", F.when(linked, fresh(_spans(whole, WEAK_ENDPOINT, 5))).otherwise(none))
    ids = F.concat("__access", "__id")
    df = df.withColumn("__secret",
        F.filter("__secret", lambda w: F.exists(ids, lambda i: _near(w, i)) & ~F.exists("__id", lambda i: _overlap(w, i))))
    secrets = F.concat("__assign", "__hex", "__secret")
    df = df.withColumn("__end",
        F.filter("__end", lambda w: F.exists(ids, lambda i: _near(w, i)) & F.exists(secrets, lambda s: _near(w, s))))
    df = df.withColumn("__id", F.filter("__id", lambda w: F.exists(secrets, lambda s: _near(w, s))))
    df = df.withColumn(spans, F.array_sort(F.concat(base, "__id", "__secret", "__end")))
    return df.drop("__assign", "__access", "__hex", "__id", "__secret", "__end")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans,
        lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds, the digest of its base spans and the list of all spans.

    A null doc_id stays null, repeated rows stay repeated, other columns are ignored.
    """
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_linked"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every found span replaced by ``MASK``; overlapping spans become one mask. Clean texts stay as they are.

    ``n_chars`` follows the new text where the text changed.
    """
    text = F.col("text")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return (
            F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, F.lit(MASK)).alias("out")))
            .when(s["end"] > acc["at"], F.struct(s["end"].alias("at"), acc["out"].alias("out")))
            .otherwise(acc)
        )

    rest = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    new = F.when(F.size("__spans") > 0, F.aggregate("__spans", start, step, rest)).otherwise(text)
    found = with_spans(docs, base="__base", spans="__spans").withColumn("__new", new)
    found = found.withColumn("n_chars", F.when(F.size("__spans") > 0, F.length("__new").cast("long")).otherwise(F.col("n_chars")))
    return found.withColumn("text", F.col("__new")).select(*docs.columns)
