"""Secret scans over a trigram inverted index (operator 1), DataFrame operations only.

From each rule's regular expression the driver derives a Boolean query of trigrams that any match must contain, as
alternatives of conjunctions. Documents are dealt into segments of about `segment_rows`; one grouped pass makes each
segment's posting lists, one list for each trigram that some rule asks for. Postings are intersected for each
conjunction and united over the alternatives, which gives the candidates; a rule's expression runs on its candidates
alone. Rules whose expression has no mandatory trigram scan every text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table, written

#: Largest set of literal strings that the analysis of an expression carries.
MAX_STRINGS = 64
EVERY = frozenset({frozenset()})


@dataclass(frozen=True)
class Rule:
    """kind; an expression that Java, Python and RE2 read alike; the group that must have min_len characters."""

    kind: str
    pattern: str
    group: int = 0
    min_len: int = 1
    base: bool = False


def any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: The three base kinds, in their order, then kinds that this method adds.
RULES = (
    Rule(
        "assign",
        "(" + "|".join(map(any_case, ("password", "passwd", "secret", "token", "api_?key"))) + ")"
        r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        8,
        True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32, True),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)


def trigrams(s: str) -> frozenset[str]:
    s = s.lower()
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def _least(query: set) -> frozenset:
    """Without conjunctions that ask for more than another one does."""
    return frozenset(q for q in query if not any(other < q for other in query))


def _both(a: frozenset, b: frozenset) -> frozenset:
    made = _least({x | y for x, y in product(a, b)})
    return made if len(made) <= MAX_STRINGS else min(a, b, key=len)


def _of_strings(strings: set[str]) -> frozenset:
    return _least({trigrams(s) for s in strings})


def _characters(items: list) -> set[str] | None:
    """The characters of a small ASCII class; None: too many, or not only literal characters."""
    found: set[str] = set()
    for op, arg in items:
        if op is C.LITERAL:
            found.add(chr(arg))
        elif op is C.RANGE and arg[1] - arg[0] < 8:
            found |= {chr(c) for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    found = {c.lower() for c in found}
    return found if len(found) <= 8 and all(c.isascii() for c in found) else None


def _analyse(node: list) -> tuple[set[str] | None, frozenset]:
    """(all strings that it can match, in lower case, if they are few; else None, the query that its matches meet)."""
    query, run, exact = EVERY, {""}, True

    def end_run():
        nonlocal query, run, exact
        query, run, exact = _both(query, _of_strings(run)), {""}, False

    for op, arg in node:
        strings, own = None, EVERY
        if op is C.LITERAL and arg < 128:
            strings = {chr(arg).lower()}
        elif op is C.IN:
            strings = _characters(arg)
        elif op is C.SUBPATTERN:
            strings, own = _analyse(arg[3])
        elif op is C.BRANCH:
            each = [_analyse(b) for b in arg[1]]
            if all(s is not None for s, _ in each):
                strings = set().union(*(s for s, _ in each))
            own = _least(set().union(*(q for _, q in each)))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, inner = arg
            once, inner_query = _analyse(inner)
            if once is not None and high == 1:
                strings = once | ({""} if low == 0 else set())
            elif low:
                own = inner_query
        elif op in (C.AT, C.ASSERT, C.ASSERT_NOT):
            continue
        if strings is not None and len(strings) * len(run) <= MAX_STRINGS:
            run = {a + b for a, b in product(run, strings)}
        else:
            end_run()
            query = _both(query, own if strings is None else _of_strings(strings))
    return (run, _of_strings(run)) if exact else (None, _both(query, _of_strings(run)))


def trigram_query(pattern: str) -> frozenset[frozenset[str]] | None:
    """Alternatives of trigram conjunctions, in lower case, one of which each match meets; None: nothing is mandatory."""
    query = _analyse(list(_parser.parse(pattern)))[1]
    return None if frozenset() in query else query


SPAN = "struct<start:int,kind_no:int,end:int,kind:string>"
#: Elements that are folded one after the other; a fold copies its array for each, so longer arrays go by blocks.
FOLDED = 128
#: Code points of a part of a text that redaction cuts its pieces from.
PART = 4096


def let(value: Column, use) -> Column:
    """use(value) with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, join) -> Column:
    """For each of an array of ints what join (a sum, a maximum) makes of 0 and those before it.

    Blocks of FOLDED elements are folded by themselves, then the blocks' totals, so time hardly grows faster than the
    array: n * FOLDED + (n / FOLDED)**2 copied numbers.
    """
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("before"))

    def fold(items: Column, of) -> Column:
        return F.aggregate(
            items,
            zero,
            lambda a, x: F.struct(
                join(a["at"], of(x)).cast("int").alias("at"), F.concat(a["before"], F.array(a["at"])).alias("before")
            ),
        )

    def all_blocks(v: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(v) - 1, F.lit(0)), F.lit(FOLDED)), lambda k: k < F.size(v))
        blocks = F.transform(starts, lambda k: fold(F.slice(v, k + 1, F.lit(FOLDED)), lambda x: x))
        return let(blocks, lambda b: F.flatten(F.zip_with(b, fold(b, lambda x: x["at"])["before"], shifted)))

    def shifted(block: Column, before: Column) -> Column:
        return F.transform(block["before"], lambda x: join(x, before).cast("int"))

    return let(values, all_blocks)


def _sum(a: Column, b: Column) -> Column:
    return a + b


def _spans(text: Column, rule: Rule, kind: int) -> Column:
    """array<struct<start, kind_no, end, kind>> of the rule's matches, leftmost and without overlap."""
    p = F.lit(rule.pattern)
    items = F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), F.length).alias("gap"),
        F.transform(F.regexp_extract_all(text, p, F.lit(0)), F.length).alias("len"),
        F.transform(F.regexp_extract_all(text, p, F.lit(rule.group)), F.length).alias("own"),
    )

    def span(x: Column, before: Column) -> Column:
        start = before + x["gap"]
        return F.struct(
            F.when(x["own"] >= rule.min_len, start).alias("start"),
            F.lit(kind).alias("kind_no"),
            (start + x["len"]).alias("end"),
            F.lit(rule.kind).alias("kind"),
        )

    def all_spans(v: Column) -> Column:
        before = running(F.transform(v, lambda x: x["gap"] + F.coalesce(x["len"], F.lit(0))), _sum)
        return F.filter(F.zip_with(v, before, span), lambda s: s["start"].isNotNull())

    return let(items, all_spans)


@dataclass(frozen=True)
class Index:
    """Posting lists, written: a row for each segment of documents, a column p0, p1, ... for each trigram."""

    postings: DataFrame
    grams: tuple[str, ...]


def build_index(keyed: DataFrame, key: str, text: str, rules: tuple[Rule, ...], segment_rows: int) -> Index:
    """Of the trigrams that the rules ask for, over documents by `key`, a long. Other rules that ask for none but these
    can be looked up in it later."""
    queries = [q for r in rules if (q := trigram_query(r.pattern))]
    grams = sorted({g for q in queries for conj in q for g in conj})
    segments = max(1, -(-keyed.count() // segment_rows))
    low = keyed.select(F.col(key).alias("k"), F.lower(text).alias("low"))

    def holds(gram: str) -> Column:
        """A gram with a mark in it is looked for only where the mark is, which is quick to see."""
        marks = [c for c in gram if not c.isalnum() and c != " "]
        return reduce(lambda a, b: a & b, [F.contains("low", F.lit(x)) for x in [*marks[:1], gram]])

    has = low.select("k", F.array(*map(holds, grams)).alias("has"))
    postings = (
        has.where(F.exists("has", lambda x: x))
        .groupBy(F.pmod("k", F.lit(segments)).alias("segment"))
        .agg(*[F.collect_set(F.when(F.col("has")[i], F.col("k"))).alias(f"p{i}") for i in range(len(grams))])
    )
    return Index(written(postings, "secret-postings"), tuple(grams))


def candidates(index: Index, key: str, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, rules): which of the indexed rules (their numbers) each document may match; others have no row."""
    wanted = {k: q for k, r in enumerate(rules) if (q := trigram_query(r.pattern))}
    lists = {g: F.col(f"p{i}") for i, g in enumerate(index.grams)}
    met = index.postings.select(
        *[
            reduce(F.array_union, [reduce(F.array_intersect, [lists[g] for g in sorted(conj)]) for conj in q]).alias(
                f"r{k}"
            )
            for k, q in wanted.items()
        ]
    )

    def with_rule(k: int) -> Column:
        return F.transform(f"r{k}", lambda x: F.struct(x.alias("k"), F.lit(k).alias("rule")))

    pairs = F.flatten(F.array(*map(with_rule, wanted)))
    hits = met.select(F.explode(pairs).alias("hit")).select("hit.k", "hit.rule")
    return hits.groupBy(F.col("k").alias(key)).agg(F.collect_set("rule").alias("rules"))


def keyed_by_hash(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with the key of the index: a hash of doc_id and text."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn(key, F.xxhash64(whole, F.col("doc_id")) if "doc_id" in docs.columns else F.xxhash64(whole))


def find_secrets(
    docs: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    text: str = "text",
    segment_rows: int = 512,
    broadcast_rows: int = 200_000,
    index: Index | None = None,
) -> DataFrame:
    """docs with one more column, secret_spans array<struct<start, kind_no, end, kind>>, sorted by start, then kind.

    Spans are code points, end exclusive. A null text counts as empty and has no span. Documents are indexed by a hash
    of their doc_id and text, so repeated rows share an entry and each gets its spans. The candidates are broadcast
    if they are at most broadcast_rows (16 bytes and a short list each), else joined by their hash. A column that is
    already named secret_spans is replaced. An empty table gives an empty result. `index` is one of these documents,
    built for these rules or for more.
    """
    key = fresh(docs, "secret_key")
    whole = F.coalesce(F.col(text), F.lit(""))
    keyed = keyed_by_hash(docs, key, text)
    if any(trigram_query(r.pattern) for r in rules):
        index = index or build_index(keyed, key, text, rules, segment_rows)
        found = written(candidates(index, key, rules), "secret-candidates")
    else:  # nothing to look up: each rule scans all texts
        found = docs.sparkSession.createDataFrame([], f"{key} long, rules array<int>")
    if found.count() <= broadcast_rows:
        found = F.broadcast(found)
    mark = fresh(docs, "secret_rules")
    joined = keyed.join(found.withColumnRenamed("rules", mark), key, "left")
    none = F.array().cast(f"array<{SPAN}>")
    each = []
    for k, r in enumerate(rules):
        may = F.array_contains(mark, k) if trigram_query(r.pattern) else F.rlike(whole, F.lit(r.pattern))
        each.append(F.when(may, _spans(whole, r, k)).otherwise(none))
    return joined.withColumn("secret_spans", F.array_sort(F.concat(*each))).drop(key, mark)


def redact(text: str, spans: str) -> Column:
    """The text with each span's characters replaced by [kind]; of spans that overlap, the first by start is named.

    A null text stays null, an empty one empty. The text is cut into parts of PART code points once, so a piece between
    two spans costs its own length and a part, wherever it is.
    """
    whole = F.col(text)
    parts = F.regexp_extract_all(whole, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))

    def piece(cut: Column, a: Column, b: Column) -> Column:
        """Characters a to b (end exclusive)."""

        def of(k: Column, start: Column, n: Column) -> Column:
            return F.coalesce(F.substring(F.get(cut, k), start + 1, n), F.lit(""))

        first, last = F.floor(a / PART).cast("int"), F.floor(b / PART).cast("int")
        middle = F.array_join(F.slice(cut, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
        over = F.concat(of(first, a % PART, F.lit(PART)), middle, of(last, F.lit(0), b % PART))
        return F.when(a >= b, "").when(first == last, of(first, a % PART, b - a)).otherwise(over)

    def joined(cut: Column) -> Column:
        ends = running(F.transform(spans, lambda s: s["end"]), F.greatest)
        pieces = F.zip_with(
            F.col(spans),
            ends,
            lambda s, at: F.when(
                s["end"] > at, F.concat(piece(cut, at, s["start"]), F.lit("["), s["kind"], F.lit("]"))
            ).otherwise(""),
        )
        last = F.array_max(F.transform(spans, lambda s: s["end"]))
        return F.concat(F.array_join(pieces, ""), piece(cut, last, F.length(whole)))

    return F.when(F.size(spans) > 0, let(parts, joined)).otherwise(whole)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A pipeline stage: every document stays; secrets in its text are replaced, and n_chars follows."""
    found = find_secrets(docs)
    # In a step of its own: a name inside a lambda would be taken for the new column of that name.
    clean, hit = fresh(docs, "clean_text"), F.size("secret_spans") > 0
    found = found.withColumn(clean, redact("text", "secret_spans"))
    counted = F.when(hit, F.length(clean).cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    new = {"text": F.col(clean).alias("text"), "n_chars": counted}
    return found.select(*[new.get(c, F.col(c)) for c in docs.columns])


def span_list(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_secrets(docs)
    base = F.filter("secret_spans", lambda s: s["kind_no"] < sum(r.base for r in RULES))

    def count(r: Rule) -> Column:
        return F.size(F.filter("secret_spans", lambda s: s["kind"] == r.kind)).cast("long").alias(f"n_{r.kind}")

    counts = [count(r) for r in RULES if r.base]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(span_list(base), 256).alias("base_sha256"),
        span_list(F.col("secret_spans")).alias("spans"),
    )


def _sql() -> str:
    def literal(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    steps, kinds = [], []
    for k, r in enumerate(RULES):
        p = literal(r.pattern)
        steps.append(
            f"string_split_regex(t, {p}) AS g{k}, regexp_extract_all(t, {p}, 0) AS m{k}, "
            f"regexp_extract_all(t, {p}, {r.group}) AS o{k}"
        )
        start = f"list_sum(list_transform(g{k}[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m{k}[1:i-1], lambda x: length(x))), 0)"
        kinds.append(
            f"list_transform(list_filter(range(1, len(m{k}) + 1), lambda i: length(o{k}[i]) >= {r.min_len}), "
            f"lambda i: {{'s': ({start})::BIGINT, 'k': {k}, 'e': ({start} + length(m{k}[i]))::BIGINT, 'n': '{r.kind}'}})"
        )
    show = "array_to_string(list_transform({}, lambda x: x.n || ':' || x.s || ':' || x.e), ',')"
    n_base = sum(r.base for r in RULES)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, {', '.join(steps)} FROM d),
s AS (SELECT doc_id, list_sort(flatten([{', '.join(kinds)}])) AS spans FROM m)
SELECT doc_id, {', '.join(f"len(list_filter(spans, lambda x: x.n = '{r.kind}')) AS n_{r.kind}" for r in RULES if r.base)},
       sha256({show.format(f'list_filter(spans, lambda x: x.k < {n_base})')}) AS base_sha256,
       {show.format('spans')} AS spans
FROM s"""


SQL = _sql()
