"""Secret scans through a trigram inverted index.

Method: each rule's regular expression is turned into a Boolean query over
trigrams (an AND of clauses; a clause is an OR of strings, a string the AND of
its trigrams).  The index holds, for every trigram that some query names, its
postings: sorted document ids in blocks of consecutive ids.  Postings are
intersected and united block by block as the queries say, and only candidates
are verified with the regular expressions.  A rule without mandatory trigrams
scans every text.  DataFrame functions only.

Plan: the index is built from one scan (plain substring tests on lower-cased
text); what is shuffled are (trigram, block, id) rows and the candidates.  The
candidates are written once; where they have at most ``BROADCAST_BYTES`` they meet
the texts by a broadcast, and no text is shuffled, else by a join on the id.  A
posting block holds at most ``block_ids`` ids however common its trigram is.
Positions are prefix sums over the matches of a text, and cuts are made within
chunks of the text, so that a text with n matches costs O(n log n).

Edge cases: null text counts as empty.  Rows are verified one by one, so
repeated rows and rows that share an id keep their own spans.  Rows without an id
are indexed under a hash of their text.  Empty tables give empty results.  Extra
columns are ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from re import _constants as ops
from re import _parser as regex_parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.session import materialise

BLOCK_IDS = 8192
BROADCAST_BYTES = 16 << 20
CHUNK = 1024  # characters of a text that a cut looks at


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str  # Java and Python read it alike
    value_group: int = 0
    min_chars: int = 0  # of the value group


#: The three base rules, as the result format defines them.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),  # AKIA[A-Z0-9]+ of 20 characters or more
    Rule("hex", r"[0-9a-f]{24,}"),  # [0-9a-f]+ of 24 characters or more
)
#: Publicly documented credential formats.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"sk_live_[0-9a-zA-Z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + MORE

Query = tuple[tuple[frozenset[str], ...], ...]


def trigram_query(pattern: str, most: int = 64) -> Query:
    """AND of ORs of trigram sets that every match of ``pattern`` satisfies; empty: none is mandatory."""
    clauses: list[set[str]] = []

    def walk(items, exact: set[str]) -> set[str]:
        for op, arg in items:
            more: set[str] | None = None
            if op is ops.LITERAL:
                more = {chr(arg)}
            elif op is ops.IN and all(o is ops.LITERAL for o, _ in arg) and len(arg) <= 8:
                more = {chr(a) for _, a in arg}
            elif op is ops.SUBPATTERN:
                exact = walk(arg[3], exact)
                continue
            elif op is ops.BRANCH:
                parts = [alone(x) for x in arg[1]]
                more = None if None in parts else set().union(*parts)
            elif op is ops.MAX_REPEAT:
                low, high, inner = arg
                part = alone(inner)
                if part and (low, high) == (0, 1):
                    more = part | {""}
                elif part and low == high == 1:
                    more = part
            elif op is ops.AT:
                continue
            if more is None or len(exact) * len(more) > most:
                clauses.append(exact)
                exact = {""}
            else:
                exact = {a + b for a in exact for b in more}
        return exact

    def alone(items) -> set[str] | None:
        """All strings that ``items`` can match, if they are few."""
        held = len(clauses)
        found = walk(items, {""})
        if len(clauses) > held:
            del clauses[held:]
            return None
        return found

    clauses.append(walk(regex_parser.parse(pattern), {""}))

    def grams(s: str) -> frozenset[str]:
        s = s.lower()
        return frozenset(s[i : i + 3] for i in range(len(s) - 2))

    def least(sets: set[frozenset[str]]) -> tuple[frozenset[str], ...]:
        """A or (A and B) is A."""
        return tuple(sorted((a for a in sets if not any(b < a for b in sets)), key=sorted))

    return tuple(least({grams(s) for s in c}) for c in clauses if all(len(s) >= 3 for s in c))


def index_id(doc_id: Column, text: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.xxhash64(text.cast("string")))


def trigram_index(docs: DataFrame, grams: list[str], block_ids: int = BLOCK_IDS) -> DataFrame:
    """block and postings (trigram -> ids) of the named trigrams, over lower-cased texts."""
    low = F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    held = docs.select(index_id(F.col("doc_id"), F.col("text")).alias("id"), low.alias("low")).select(
        "id", F.array_compact(F.array(*[F.when(F.col("low").contains(g), F.lit(g)) for g in grams])).alias("grams")
    )
    each = held.select("id", F.floor(F.col("id") / F.lit(block_ids)).alias("block"), F.explode_outer("grams").alias("gram")).filter("gram is not null")
    lists = each.groupBy("block", "gram").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    return lists.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("gram", "ids"))).alias("postings"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES, block_ids: int = BLOCK_IDS) -> DataFrame:
    """id and rules (the kinds to verify) of each document that some indexed rule may match."""
    asked = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    grams = sorted({g for q in asked.values() for clause in q for s in clause for g in s})
    none = F.array().cast("array<bigint>")

    def ids(gram: str) -> Column:
        return F.coalesce(F.try_element_at("postings", F.lit(gram)), none)

    def answer(q: Query) -> Column:
        clauses = [reduce(F.array_union, [reduce(F.array_intersect, [ids(g) for g in sorted(s)]) for s in clause]) for clause in q]
        return reduce(F.array_intersect, clauses)

    index = trigram_index(docs, grams, block_ids)
    found = index.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), answer(q).alias("ids")) for k, q in asked.items()])).alias("x"))
    return found.select("x.kind", F.explode("x.ids").alias("id")).groupBy("id").agg(F.collect_set("kind").alias("rules"))


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Prefix sums, or another associative ``op``, of an array, by doubling the reach: O(n log n)."""
    rounds = F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)).cast("double"))).cast("int")

    def wider(acc: Column, k: Column) -> Column:
        reach = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(acc, lambda x, i: F.when(i < reach, x).otherwise(op(F.get(acc, i - reach), x)))

    steps = F.filter(F.sequence(F.lit(0), rounds), lambda k: k < rounds)
    return F.aggregate(steps, values, wider)


def spans(text: Column, rule: Rule) -> Column:
    """Sorted (start, end) of the rule's leftmost non-overlapping matches, in code points."""
    found, gaps = F.regexp_extract_all(text, F.lit(rule.pattern), 0), F.split(text, rule.pattern, -1)
    value = F.regexp_extract_all(text, F.lit(rule.pattern), rule.value_group) if rule.value_group else found
    sized = F.transform(F.filter(F.arrays_zip(found.alias("m"), gaps.alias("g"), value.alias("v")), lambda x: x["m"].isNotNull()), sizes)  # there is one gap more than matches

    def placed(all_: Column) -> Column:
        ends = running(F.transform(all_, lambda x: x["g"] + x["m"]), lambda a, b: a + b)
        both = F.zip_with(all_, ends, lambda x, e: F.struct((e - x["m"]).alias("s"), e.alias("e"), x["v"].alias("v")))
        return F.transform(F.filter(both, lambda x: x["v"] >= rule.min_chars), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))

    return let(sized, placed)


def sizes(x: Column) -> Column:
    return F.struct(*[F.char_length(x[c]).alias(c) for c in "mgv"])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def with_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """row (the document's columns, as a struct), text and spans: an array of (s, k, e) sorted by start and rule order."""
    asked = {r.kind for r in rules if trigram_query(r.pattern)}
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))  # so that no name can clash
    found = materialise(candidates(docs, rules), "secret-candidates")
    if (found.agg(F.sum(F.lit(24) + F.octet_length(F.array_join("rules", " ")))).first()[0] or 0) <= broadcast_bytes:
        found = F.broadcast(found)
    joined = rows.join(found, index_id(F.col("row.doc_id"), F.col("row.text")) == F.col("id"), "left")
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    none = F.array().cast("array<struct<s:int,e:int>>")

    def verified(k: int, rule: Rule) -> Column:
        maybe = F.array_contains("rules", rule.kind) if rule.kind in asked else text.rlike(rule.pattern)
        own = F.when(F.coalesce(maybe, F.lit(False)), spans(text, rule)).otherwise(none)
        return F.transform(own, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))

    parts = [verified(k, rule) for k, rule in enumerate(rules)]
    return joined.select("row", text.alias("text"), F.array_sort(F.concat(*parts)).alias("spans"))


def span_text(found: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"], x["e"])), ",")


def scan(docs: DataFrame) -> DataFrame:
    """Per document: counts and digest of the base spans, and all spans as text."""
    found = with_spans(docs)
    base = F.filter("spans", lambda x: x["k"] < len(BASE))

    def count(k: int) -> Column:
        return F.size(F.filter("spans", lambda x: x["k"] == k)).cast("long")

    counts = [count(k).alias(f"n_{r.kind}") for k, r in enumerate(BASE)]
    return found.select("row.doc_id", *counts, F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def marked(text: Column, found: Column, mark: str) -> Column:
    """``text`` with ``mark`` in place of each span, and of spans that overlap one."""

    def cut(chunks: Column, a: Column, b: Column) -> Column:
        """Characters ``a`` to ``b`` of the text, read from its chunks."""

        def part(i: Column, low: Column, high: Column) -> Column:
            return F.substr(F.coalesce(F.get(chunks, i), F.lit("")), low + 1, high - low)

        i, j = F.floor(a / F.lit(CHUNK)).cast("int"), F.floor(b / F.lit(CHUNK)).cast("int")
        across = F.concat(part(i, a % CHUNK, F.lit(CHUNK)), F.array_join(F.slice(chunks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), part(j, F.lit(0), b % CHUNK))
        return F.when(i == j, part(i, a % CHUNK, b % CHUNK)).otherwise(across)

    def joined(chunks: Column, ends: Column) -> Column:
        def piece(x: Column, i: Column) -> Column:
            at = F.when(i == 0, F.lit(0)).otherwise(F.get(ends, i - 1))
            return F.when(x["s"] >= at, F.concat(cut(chunks, at, x["s"]), F.lit(mark))).otherwise(F.lit(""))

        last = cut(chunks, F.element_at(ends, -1), F.char_length(text))
        return F.concat(F.array_join(F.transform(found, piece), ""), last)

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), 0)
    ends = running(F.transform(found, lambda x: x["e"]), lambda a, b: F.greatest(a, b))
    return let(chunks, lambda c: let(ends, lambda e: joined(c, e)))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of the text replaced by ``mark``; overlapping spans by one."""
    found = with_spans(docs)
    cut = F.when(F.size("spans") > 0, marked(F.col("text"), F.col("spans"), mark)).otherwise(F.col("row.text"))
    return found.select(*[cut.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
