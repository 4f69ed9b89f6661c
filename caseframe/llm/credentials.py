"""Secrets in texts, and credentials put together from their parts.

Strong candidates stand on their own. Weak ones - a user or client name, a long mixed string, an
endpoint - are everywhere, and are reported only when a complementary part stands within the same
scope: candidates of a text meet in an interval join, a range window over their positions.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseframe.llm.shared import keep, ship

#: Characters between the end of one part and the start of another that belong together.
SCOPE = 400

# The kinds of strong candidates, in the order in which they are listed.
STRONG = ("assign", "access", "hex")
WEAK = ("identifier", "secret", "endpoint")
KINDS = STRONG + WEAK

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
                     r"([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_IDENTIFIER = re.compile(r"""(?:access_?key_?id|client_?id|user(?:_?name)?|login|account)["']?\x20?[:=]"""
                         r"""\x20?["']?([A-Za-z0-9._@-]{3,}+)""", re.I | re.A)
_MIXED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}+", re.A)
_ENDPOINT = re.compile(r"""(?:https?|s3|jdbc:[a-z]++|postgres(?:ql)?|mysql|redis|mongodb|amqp)://[^\s"'<>]{4,}+"""
                       r"""|(?:host|endpoint)["']?\x20?[:=]\x20?["']?[A-Za-z0-9.:/_-]{4,}+""", re.I | re.A)
_WORDS = ("passw", "secret", "token", "api", "AKIA", "key", "client", "user", "login", "account")


def strong(text: str) -> list[tuple[str, int, int]]:
    """Kind, start and end of the strong candidates, in code points, by start and then kind."""
    found = []
    lower = text.lower()
    if any(w in lower for w in ("passw", "secret", "token", "api")):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def weak(text: str) -> list[tuple[str, int, int]]:
    """Candidates that count only in company."""
    found = []
    if "=" in text or ":" in text:
        found += [("identifier", *m.span()) for m in _IDENTIFIER.finditer(text)]
        found += [("endpoint", *m.span()) for m in _ENDPOINT.finditer(text)]
    found += [("secret", *m.span()) for m in _MIXED.finditer(text)
              if re.search("[a-z]", m[0]) and re.search("[A-Z]", m[0]) and re.search("[0-9]", m[0])]
    return found


SPANS = "array<struct<kind:string,start:int,end:int>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, base and weak spans of every row; the text itself goes no further."""
    def scan(batches):
        for batch in batches:
            texts = [t or "" for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *(
                    pa.array([[dict(zip(("kind", "start", "end"), s)) for s in f(t)] for t in texts], _SPANS)
                    for f in (strong, weak))], names=["doc_id", "base", "weak"])

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(scan, f"doc_id bigint, base {SPANS}, weak {SPANS}")


def linked(rows: DataFrame, scope: int = SCOPE) -> DataFrame:
    """_row, kind, start, end of the weak spans that have their complement in scope.

    An access identifier needs a secret, a secret an identifier, an endpoint a secret; strong
    candidates count as parts too. Scope is the interval between the end of one span and the start of
    the other. Identifier and secret must not overlap, as an identifier's own value is no secret; a
    secret may stand in an endpoint. Each span is compared with the nearest parts, not with each other one.
    """
    spans = rows.filter(F.size("weak") > 0).select(
        "_row", F.explode(F.concat("base", "weak")).alias("s")).select("_row", "s.*")
    ends = spans.select("*", F.posexplode(F.array("start", "end")).alias("is_end", "at"))
    forth = Window.partitionBy("_row").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy("_row").orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, 0)
    begins, is_end = F.col("is_end") == 0, F.col("is_end") == 1
    for name, part in (("identifier", F.col("kind").isin("access", "identifier")),
                       ("key", F.col("kind").isin("assign", "hex", "secret"))):
        ends = (ends.withColumn(f"{name}_before", F.max(F.when(part & is_end, F.col("end"))).over(forth))
                .withColumn(f"{name}_begun", F.max(F.when(part & begins, F.col("end"))).over(forth))
                .withColumn(f"{name}_after", F.min(F.when(part & begins, F.col("start"))).over(back)))

    def near(name: str):
        return F.when(begins, F.col("start") - F.col(f"{name}_before") <= scope).otherwise(
            F.col(f"{name}_after") - F.col("end") <= scope)

    complete = F.when(F.col("kind") == "secret", near("identifier")).when(
        F.col("kind") == "identifier", near("key")).otherwise(is_end & (
            F.coalesce(F.col("start") - F.col("key_begun") <= scope, F.lit(False)) | near("key")))
    return ends.filter(F.col("kind").isin(*WEAK) & complete).select("_row", "kind", "start", "end").distinct()


def _listed(spans, kinds=KINDS):
    """kind:start:end, by start and then kind, comma-joined."""
    order = F.array(*(F.lit(k) for k in kinds))
    keyed = F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.array_position(order, s["kind"]).alias("at"),
        s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(spans, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def find_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, base (strong spans), added (weak spans with their complement) of every row.

    A null text is empty and has no spans. Rows that repeat an id are told apart by a row number.
    Spans that a strong one covers are not added. Other columns are ignored; a table without rows
    gives none. Ties in position are listed in the order of KINDS.
    """
    ship(docs.sparkSession)
    rows = keep(candidates(docs).withColumn("_row", F.monotonically_increasing_id()), "candidates")
    more = linked(rows, scope).groupBy("_row").agg(
        F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    none = F.array().cast(SPANS)
    joined = rows.join(more, "_row", "left").select(
        "doc_id", "base", F.coalesce("added", none).alias("added"))
    alone = F.filter("added", lambda a: ~F.exists("base", lambda b: (
        (a["start"] < b["end"]) & (b["start"] < a["end"]))))
    return joined.withColumn("added", alone)


def listed(found: DataFrame, kinds: tuple[str, ...], base_kinds: tuple[str, ...]) -> DataFrame:
    """The spans as text: counts and digest of the base, and all spans."""
    return found.select(
        "doc_id", *(counted("base", k).alias(f"n_{k}") for k in base_kinds),
        F.sha2(_listed(F.col("base"), kinds), 256).alias("base_sha256"),
        _listed(F.concat("base", "added"), kinds).alias("spans"))
