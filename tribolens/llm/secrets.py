"""Operator 5: secret scan with linking of credential parts, on built-in expressions only.

Three kinds of base spans are found by themselves: assignments of a password-like name, access key ids and long hexadecimal
strings. Other parts are weak: a user name, an account id, a service address or a bare token of mixed letters and digits means little
alone. Each part plays a role (identifier, secret or endpoint), and a weak part is reported only if a part of another role lies
in its scope, that is, fewer than SCOPE code points away in the same document. This is an interval join: parts are put
into cells of SCOPE code points, and a weak part meets the parts of its own and the two neighbouring cells, so a document
full of parts costs in proportion to its length, and no cell holds more parts than fit into SCOPE code points.

Spans are found with a pattern that takes the gap before each match along: match places are running sums of gap and match
lengths, and the search continues behind each match, failing ones included. Each search is tied to the end of the last match
(\\G); otherwise the text behind the last match would be searched again from each of its characters. Places are summed up
in chunks of CHUNK matches, so a text with many of them costs little more than in proportion.

Defined results: null or empty text has no spans. Rows with one id and different texts are judged each by itself; repeated rows
give repeated results. A null id is an id like any other. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tribolens.llm.columns import join_rows, let
from tribolens.plans.storage import materialise

SCOPE = 200
CHUNK = 128
# Kinds in the order in which they are listed, with pattern, group measured, least length and role.
ASSIGN = (r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]+")
BASE = {
    "assign": (ASSIGN, 6, "secret", r"(?i)password|passwd|secret|token|api_?key"),
    # The least length inside the pattern finds the same spans: a run that is too short has no longer match inside it.
    "access": (("", r"AKIA[A-Z0-9]{16,}"), 20, "identifier", r"AKIA"),
    "hex": (("", r"[0-9a-f]{24,}"), 24, "secret", r"[0-9a-f]{24}"),
}
# Weak kinds: reported only next to a part of another role.
WEAK = {
    "user": ((r"""(?:(?i:user(?:name)?|login|account|client_?id))["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.@-]+"), 3,
             "identifier", r"(?i)user|login|account|client_?id"),
    "endpoint": (("", r"(?:https?|ftp|jdbc:[a-z]+|postgres|mysql|mongodb|redis|amqp)://[^\s\"'<>]+"), 10, "endpoint", r"://"),
    # What follows the pattern that a text must hold: patterns that the span itself must hold.
    "bare": (("", r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"), 20, "secret", r"[A-Za-z0-9+/_=-]{20}",
             r"[0-9]", r"[a-z]", r"[A-Z]"),
}
KINDS = [*BASE, *WEAK]
SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def spans_of(text: Column, kind: str, rule: tuple) -> Column:
    """Spans (start, rank, end, kind) of one kind in a text; matches whose measured part fails are dropped."""
    (head, value), least, _, hint, *holds = rule
    pattern = F.lit(rf"(?s)\G(.*?)({head})({value})")
    gap, lead, body = (F.regexp_extract_all(text, pattern, F.lit(group)) for group in (1, 2, 3))

    def sized(part: Column) -> Column:
        fits = F.length(part["2"]) >= least
        for inner in holds:
            fits = fits & part["2"].rlike(inner)
        return F.struct(F.length(part["0"]).alias("gap"), (F.length(part["1"]) + F.length(part["2"])).alias("size"),
                        fits.alias("fits"))

    def place(chunk: Column, begin: Column) -> Column:
        def step(state: Column, part: Column) -> Column:
            start = state["at"] + part["gap"]
            span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"),
                            (start + part["size"]).alias("end"), F.lit(kind).alias("kind"))
            found = F.when(part["fits"], F.concat(state["found"], F.array(span).cast(SPAN)))
            return F.struct((start + part["size"]).alias("at"), found.otherwise(state["found"]).alias("found"))

        return F.aggregate(chunk, F.struct(begin.alias("at"), F.array().cast(SPAN).alias("found")), step)["found"]

    def place_all(parts: Column) -> Column:
        def with_begins(chunks: Column) -> Column:
            lengths = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda n, p: n + p["gap"] + p["size"]))
            return let(running(lengths, lambda x, y: x + y), lambda begins: F.flatten(
                F.transform(chunks, lambda c, i: place(c, F.get(begins, i)))))

        return let(in_chunks(parts), with_begins)

    return F.when(text.rlike(hint), let(F.transform(F.arrays_zip(gap, lead, body), sized), place_all)).otherwise(
        F.array().cast(SPAN))


def in_chunks(items: Column) -> Column:
    """An array as an array of arrays of CHUNK items: an array grown item by item is copied at each step, so long ones are
    grown in chunks."""
    starts = F.when(F.size(items) > 0, F.sequence(F.lit(1), F.size(items), F.lit(CHUNK))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(items, i, CHUNK))


def running(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """What `merge` makes of all values before each place, from 0; one entry more than there are values."""
    return F.aggregate(values, F.array(F.lit(0)), lambda done, v: F.concat(done, F.array(merge(F.element_at(done, -1), v))))


def with_cells(parts: DataFrame, reach: int) -> DataFrame:
    """One row per cell that a part, widened by `reach` on both sides, touches."""
    cells = F.sequence(F.floor((F.col("start") - reach) / SCOPE), F.floor((F.col("end") + reach) / SCOPE))
    return parts.select("*", F.explode(cells).alias("cell"))


def linked_parts(parts: DataFrame) -> DataFrame:
    """Weak parts with a part of another role in their scope; `parts` has doc_id, tag, start, rank, end, kind."""
    roles = F.create_map(*(F.lit(x) for kind in KINDS for x in (kind, {**BASE, **WEAK}[kind][2])))
    parts = parts.withColumn("role", roles[F.col("kind")])
    weak = with_cells(parts.filter(F.col("rank") >= len(BASE)), SCOPE).alias("w")
    near = with_cells(parts, 0).alias("p")
    meet = (F.col("w.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("w.tag") == F.col("p.tag"))
            & (F.col("w.cell") == F.col("p.cell")) & (F.col("w.role") != F.col("p.role"))
            & (F.col("p.start") < F.col("w.end") + SCOPE) & (F.col("w.start") < F.col("p.end") + SCOPE))
    return weak.join(near, meet, "left_semi").select("doc_id", "tag", "start", "rank", "end", "kind").distinct()


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, tag (hash of the text) and all reported spans in order, per document."""
    text = F.coalesce("text", F.lit(""))
    found = materialise(docs.select(F.col("doc_id").cast("long"), F.hash("text").alias("tag"), F.concat(
        *(spans_of(text, kind, rule) for kind, rule in {**BASE, **WEAK}.items())).alias("parts")))
    parts = found.filter(F.exists("parts", lambda s: s["rank"] >= len(BASE))).distinct().select(
        "doc_id", "tag", F.inline("parts"))
    linked = linked_parts(parts).groupBy("doc_id", "tag").agg(
        F.collect_list(F.struct("start", "rank", "end", "kind")).alias("linked"))
    base = F.filter("parts", lambda s: s["rank"] < len(BASE))
    return join_rows(found, linked).select("doc_id", "tag", F.sort_array(
        F.concat(base, F.coalesce("linked", F.array().cast(SPAN)))).alias("spans"))


def base_spans(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["rank"] < len(BASE))


def count_of(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column, mark: str = "[REDACTED]") -> Column:
    """Text with its spans, in order of their starts and overlapping ones merged, replaced by a mark.

    A chunk of spans rewrites its own stretch of the text, from the furthest end before it to the furthest end in it, so neither the
    text nor the result is walked once per span.
    """
    def rewritten(chunk: Column, piece: Column, begin: Column) -> Column:
        def step(state: Column, span: Column) -> Column:
            gap = F.substring(piece, state["at"] - begin + 1, span["start"] - state["at"])
            out = F.when(span["start"] >= state["at"], F.concat(state["out"], gap, F.lit(mark))).otherwise(state["out"])
            return F.struct(F.greatest(state["at"], span["end"]).alias("at"), out.alias("out"))

        return F.aggregate(chunk, F.struct(begin.alias("at"), F.lit("").alias("out")), step)["out"]

    def rewritten_all(chunks: Column) -> Column:
        ends = running(F.transform(chunks, lambda c: F.array_max(c["end"])), F.greatest)

        def joined(begins: Column) -> Column:
            parts = F.transform(chunks, lambda c, i: let(
                F.substring(text, F.get(begins, i) + 1, F.get(begins, i + 1) - F.get(begins, i)),
                lambda piece: rewritten(c, piece, F.get(begins, i))))
            return F.concat(F.array_join(parts, ""), F.substring(text, F.element_at(begins, -1) + 1, F.length(text)))

        return let(ends, joined)

    return let(in_chunks(spans), rewritten_all)
