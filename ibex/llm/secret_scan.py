"""Secret scanning with a trigram inverted index, in DataFrame operations.

1. Each rule's regex gives a Boolean trigram query: the trigrams of its
   mandatory literals, with alternatives for its branches, in lower case.
2. The index holds, for every trigram that a query names, the documents whose
   lower-cased text contains it (one posting per trigram and document).
3. Each alternative of a query is the intersection of its postings; the
   documents found are the rule's candidates.
4. Candidates are verified with the regex itself.  A rule without a mandatory
   trigram is run over every text.

Spans are found without leaving the JVM: the matches in order and the pieces
between them give every match's offset by a running sum.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ibex.llm.frames import checkpointed, text_of

#: More than this many alternatives or literals are not worth an index query.
_MAX_ALTERNATIVES = 64


@dataclass(frozen=True)
class SecretRule:
    """``group`` of a match must have ``at_least`` characters.  Patterns are
    those that Python's and Java's regexes read alike.  ``long`` may name a
    pattern whose matches are the long enough ones of ``pattern``."""

    kind: str
    pattern: str
    at_least: int = 1
    group: int = 0
    ignore_case: bool = False
    long: str = ""

    @property
    def java(self) -> str:
        return ("(?i)" if self.ignore_case else "") + (self.long or self.pattern)


#: The base rules of the contract, in its order of kinds.
BASE = (
    SecretRule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
               12, 2, True),
    # a match is the rest of a run: the long ones are the runs that are long
    SecretRule("access", r"AKIA[A-Z0-9]+", 18, long=r"AKIA[A-Z0-9]{14,}"),
    SecretRule("hex", r"[0-9a-f]+", 16, long=r"[0-9a-f]{16,}"),
)
#: Public formats of further secrets.
FURTHER = (
    SecretRule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    SecretRule("webtoken", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    SecretRule("forge", r"gh[pousr]_[A-Za-z0-9]{36}"),
    SecretRule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """The query of a regex as a list of alternatives, each a set of lower-case
    trigrams that a match must contain; None if some match needs none.

    Literal runs are followed through concatenation, groups, branches and
    required repeats; anything else ends a run.
    """
    tree = re._parser.parse(pattern)

    def walk(items) -> list[tuple[frozenset[str], str | None]]:
        """Alternatives of a sequence: trigrams so far, and the literal if the
        whole alternative is one."""
        done: list[tuple[frozenset[str], str, bool]] = [(frozenset(), "", True)]  # trigrams, open run, all literal
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                step = [(frozenset(), chr(arg).lower())]
            elif name == "SUBPATTERN":
                step = walk(arg[-1])
            elif name == "BRANCH":
                step = [x for branch in arg[1] for x in walk(branch)]
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] > 0:
                step = [(grams, text if arg[0] == arg[1] == 1 else None) for grams, text in walk(arg[2])]
            else:
                step = [(frozenset(), None)]
            if len(done) * len(step) > _MAX_ALTERNATIVES:
                step = [(frozenset(), None)]
            after = []
            for (grams, run, whole), (more, text) in product(done, step):
                if text is None:
                    after.append((grams | more, "", False))
                else:
                    joined = run + text
                    new = frozenset(joined[i:i + 3] for i in range(len(joined) - 2))
                    after.append((grams | more | new, joined, whole))
            done = after
        return [(grams, run if whole else None) for grams, run, whole in done]

    out = list(dict.fromkeys(grams for grams, _ in walk(tree)))
    # an alternative that contains another one adds nothing
    out = [a for a in out if not any(b < a for b in out)]
    return None if any(not a for a in out) else out


def trigram_index(docs: DataFrame, grams: Sequence[str], id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Postings (gram, id) of the trigrams asked for."""
    lowered = docs.select(F.col(id_col).alias("id"), F.lower(F.col(text_col)).alias("lowered"))
    found = F.array_compact(F.array(*(F.when(F.contains("lowered", F.lit(g)), F.lit(g)) for g in grams)))
    return lowered.select("id", F.explode(found).alias("gram")).distinct()


def candidates(postings: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """(id, kinds): the rules whose query each document satisfies.  Every
    alternative of every query is an intersection of postings."""
    rows = [(kind, n, len(alternative), gram) for kind, query in sorted(queries.items())
            for n, alternative in enumerate(query) for gram in sorted(alternative)]
    asked = postings.sparkSession.createDataFrame(rows, "kind string, alternative int, size int, gram string")
    hits = (postings.join(F.broadcast(asked), "gram")  # a few trigrams per rule
            .groupBy("id", "kind", "alternative").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size"))
            .where("n = size"))
    return hits.groupBy("id").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))  # at most one entry per rule


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, not for each use."""
    return F.transform(F.array(value), body)[0]


def _spans(text: Column, rule: SecretRule, number: int) -> Column:
    """(start, kind number, end, kind) of every leftmost non-overlapping match
    whose group is long enough; offsets in code points.

    Offsets are sums over the matches before.  The matches are cut into about
    as many chunks as a chunk has matches, so no array grows match by match to
    more than a chunk."""
    matches, pieces = F.regexp_extract_all(text, F.lit(rule.java), F.lit(0)), F.split(text, rule.java, -1)
    groups = F.regexp_extract_all(text, F.lit(rule.java), F.lit(rule.group)) if rule.group else F.array().cast("array<string>")
    none = F.array().cast("array<struct<start:int,number:int,end:int,kind:string>>")

    def sizes(found: Column) -> Column:
        rows = F.arrays_zip(found.alias("m"), F.slice(pieces, F.lit(1), F.size(found)).alias("before"), groups.alias("g"))
        return F.transform(rows, lambda r: F.struct(
            F.length(r["before"]).alias("before"), F.length(r["m"]).alias("m"),
            F.length(r["g" if rule.group else "m"]).alias("g")))

    def step(state: Column, row: Column) -> Column:
        start = state["at"] + row["before"]
        end = start + row["m"]
        span = F.struct(start.alias("start"), F.lit(number).alias("number"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct(end.alias("at"), F.when(row["g"] >= rule.at_least, F.concat(state["found"], F.array(span)))
                        .otherwise(state["found"]).alias("found"))

    def in_chunk(chunk: Column, at: Column) -> Column:
        return F.aggregate(chunk, F.struct(at.alias("at"), none.alias("found")), step, lambda s: s["found"])

    def in_chunks(chunks: Column) -> Column:
        def total(chunk):
            return F.aggregate(chunk, F.lit(0), lambda n, r: n + r["before"] + r["m"])

        begins = F.aggregate(chunks, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("begins")),
                             lambda s, c: F.struct((s["at"] + total(c)).alias("at"), F.concat(s["begins"], F.array(s["at"])).alias("begins")),
                             lambda s: s["begins"])
        return F.flatten(F.zip_with(chunks, begins, in_chunk))

    def in_all(rows: Column) -> Column:
        width = F.greatest(F.lit(64), F.ceil(F.sqrt(F.size(rows)))).cast("int")
        chunks = _let(width, lambda w: F.transform(F.sequence(F.lit(0), F.size(rows) - 1, w), lambda i: F.slice(rows, i + 1, w)))
        return F.when(F.size(rows) == 0, none).otherwise(_let(chunks, in_chunks))

    return F.when(F.rlike(text, F.lit(rule.java)), _let(sizes(matches), in_all)).otherwise(none)


def span_text(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind as listed, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                rules: Sequence[SecretRule] = BASE + FURTHER, *, broadcast_rows: int = 200_000) -> DataFrame:
    """One row per input row: ``id`` and ``spans``, an array of (start,
    number, end, kind) sorted by start, then by the rule's place in ``rules``.

    A null text counts as empty.  Rows with equal or null ids are scanned one
    by one (a candidate id makes all its rows candidates, which the regex
    decides).  Other columns are ignored, whatever their names.  An empty
    table gives an empty result.

    The candidate ids are counted: up to ``broadcast_rows`` of them (a few MB)
    are broadcast to the texts; more are joined by a shuffle on the id.
    """
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not None}
    frame = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    if queries:
        grams = sorted({g for query in queries.values() for alternative in query for g in alternative})
        found = checkpointed(candidates(trigram_index(frame, grams), queries))
        if found.count() <= broadcast_rows:
            found = F.broadcast(found)
        found = found.withColumnRenamed("id", "candidate_id")
        frame = frame.join(found, F.col("id").eqNullSafe(F.col("candidate_id")), "left")
    else:
        frame = frame.withColumn("kinds", F.lit(None).cast("array<string>"))
    text, parts = F.col("text"), []
    for number, rule in enumerate(rules):
        spans = _spans(text, rule, number)
        if rule.kind in queries:
            spans = F.when(F.array_contains("kinds", rule.kind), spans)
        parts.append(F.coalesce(spans, F.array().cast("array<struct<start:int,number:int,end:int,kind:string>>")))
    return frame.select("id", F.array_sort(F.concat(*parts)).alias("spans"))
