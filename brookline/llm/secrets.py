"""Secret scans over a trigram inverted index, with DataFrame functions only.

From each rule's regex a Boolean query over trigrams is derived: what every match must contain. The
index holds, for the trigrams of those queries, the postings: per trigram and block of documents the
array of document keys. Queries are answered by intersecting and uniting postings within a block,
which gives candidate documents; those are verified with the regex. A rule without mandatory trigrams
(a run of hex digits, say) scans every document.

A key is a 64-bit hash of doc_id and text; two documents with one key share postings, which only
makes a needless candidate. Blocks hold about ``block_docs`` keys each, so no posting array is
unbounded, and copies of one text share a key.

Spans count code points, end exclusive. For each kind matches are leftmost and do not overlap;
matches that fail their length are dropped after matching, so they still consume their text. A private
key spans its header, body and END line; without an END line, the lines of base64 after the header.

Defined results: a null text is empty and has no spans; null doc_ids are kept; repeated rows get equal
results; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations


from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

try:
    from re import _constants as sre
    from re import _parser as sre_parse
except ImportError:  # before Python 3.11
    import sre_constants as sre
    import sre_parse


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str
    least: int = 0  # characters of the group that a match needs
    group: int = 0
    base: bool = False


#: The base rules, as their contract states them.
BASE = (
    Rule("assign", r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20, 0, True),
    Rule("hex", r"[0-9a-f]+", 24, 0, True),
)
#: Lines that follow the header of a private key without an END line: base64, or its two header fields. Line ends may be escaped, or long runs stand
#: after spaces. Possessive, so that Java's matcher loops over the lines and does not recurse.
_KEY_LINES = (
    r"(?:(?:(?:[ \t\r]|\\r)*+(?:\n|\\n))++[ \t]*+(?:(?:Proc-Type|DEK-Info):[^\r\n\\]*+|[A-Za-z0-9+/=]++(?=[ \t\r]*(?:\n|\\|$)))"
    r"|[ \t]++(?:[A-Za-z0-9+/]{40,}+={0,2}|[A-Za-z0-9+/]++={1,2}))*+"
)
#: Formats of well-known credentials.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("privatekey", r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----(?:(?:(?!-----BEGIN )[\s\S])*?-----END [A-Z ]{0,32}PRIVATE KEY-----|" + _KEY_LINES + ")"),
    Rule("url", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]+:[^\s/:@]+@[A-Za-z0-9.-]+"),
)
RULES = BASE + MORE

# ---- Boolean trigram queries: None (anything matches), ("and"|"or", parts), or a trigram


def _all(parts: list) -> object:
    parts = [p for p in parts if p is not None]
    return parts[0] if len(parts) == 1 else ("and", tuple(dict.fromkeys(parts))) if parts else None


def _any(parts: list) -> object:
    if not parts or any(p is None for p in parts):
        return None
    parts = list(dict.fromkeys(parts))
    plain = {p: set(p[1]) if p[0] == "and" else {p} for p in parts if isinstance(p, str) or all(isinstance(x, str) for x in p[1])}
    parts = [p for p in parts if p not in plain or not any(plain[q] < plain[p] for q in plain)]  # a weaker alternative stands for a stronger one
    return parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _literal(s: str) -> object:
    return _all([s[i : i + 3] for i in range(len(s) - 2)])


#: A set of strings larger than this is given up as exact.
MOST = 64


def _strings(item: tuple) -> list[str] | None:
    """All strings that a part of a regex matches, if they are few."""
    op, arg = item
    if op is sre.LITERAL:
        return [chr(arg).lower()]
    if op is sre.IN:
        if all(o is sre.LITERAL for o, _ in arg) and len(arg) <= MOST:
            return sorted({chr(a).lower() for _, a in arg})
        if all(o in (sre.LITERAL, sre.RANGE) for o, _ in arg):
            n = sum(1 if o is sre.LITERAL else a[1] - a[0] + 1 for o, a in arg)
            if n <= 4:
                return sorted({chr(x).lower() for o, a in arg for x in ([a] if o is sre.LITERAL else range(a[0], a[1] + 1))})
    if op is sre.SUBPATTERN:
        return _sequence_strings(arg[3])
    if op is sre.BRANCH:
        found = [_sequence_strings(x) for x in arg[1]]
        return sorted({s for x in found for s in x}) if all(x is not None for x in found) else None
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] <= 4:
        inner = _sequence_strings(arg[2])
        return None if inner is None else _few({"".join(x) for n in range(arg[0], arg[1] + 1) for x in product(inner, repeat=n)})
    return None


def _few(s: set[str]) -> list[str] | None:
    return sorted(s) if len(s) <= MOST else None


def _sequence_strings(items) -> list[str] | None:
    out: list[str] | None = [""]
    for x in items:
        s = _strings(x)
        out = None if s is None or out is None else _few({a + b for a in out for b in s})
        if out is None:
            return None
    return out


def _query(items) -> object:
    """What every match of a sequence contains: runs of exact strings, and what single parts require."""
    needs, run = [], [""]

    def flush() -> None:
        nonlocal run
        needs.append(_any([_literal(s) for s in run]))
        run = [""]

    for item in items:
        s = _strings(item)
        longer = None if s is None else _few({a + b for a in run for b in s})
        if longer is not None:
            run = longer
            continue
        flush()
        if s is not None:
            run = s
            continue
        op, arg = item
        if op is sre.SUBPATTERN:
            needs.append(_query(arg[3]))
        elif op is sre.BRANCH:
            needs.append(_any([_query(x) for x in arg[1]]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
            needs.append(_query(arg[2]))
    flush()
    return _all(needs)


def trigram_query(regex: str) -> object:
    """The Boolean query over lower-cased trigrams that every text with a match meets; None if there is none."""
    return _query(sre_parse.parse(regex.replace("(?i)", "")))


def trigrams(query: object) -> set[str]:
    return set() if query is None else {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


def _postings(query: object) -> Column:
    """The keys that meet a query: postings, intersected for "and" and united for "or"."""
    none = F.array().cast("array<long>")
    if isinstance(query, str):
        return F.coalesce(F.col("postings")[query], none)
    op, parts = query
    merge = F.array_intersect if op == "and" else F.array_union
    plain = [p for p in parts if isinstance(p, str)]
    found = [_postings(p) for p in parts if not isinstance(p, str)]
    if plain:
        rest = F.array(*[F.lit(t) for t in plain[1:]]).cast("array<string>")
        found.append(F.reduce(rest, _postings(plain[0]), lambda keys, t: merge(keys, F.coalesce(F.col("postings")[t], none))))
    out = found[0]
    for x in found[1:]:
        out = merge(out, x)
    return out


def doc_key() -> Column:
    return F.xxhash64(F.col("doc_id"), F.coalesce("text", F.lit("")))


def index(docs: DataFrame, vocabulary: list[str], block_docs: int = 4096) -> DataFrame:
    """block, trigram, keys: the postings of the vocabulary's trigrams in the lower-cased texts."""
    blocks = max(1, docs.count() // block_docs)
    # a lambda's argument is evaluated once: the text is lower-cased once for all trigrams
    has = F.transform(F.array(F.lower(F.coalesce("text", F.lit("")))), lambda low: F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(i)) for i, t in enumerate(vocabulary)])))
    d = docs.select(doc_key().alias("key"), has[0].alias("has"))
    d = d.select("key", F.explode("has").alias("t"))
    names = F.array(*[F.lit(t) for t in vocabulary])
    return d.groupBy(F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"), "t").agg(F.collect_set("key").alias("keys")).select("block", F.get(names, F.col("t")).alias("trigram"), "keys")


def candidates(postings: DataFrame, queries: dict[str, object]) -> DataFrame:
    """key, rules: the rules whose Boolean query a document meets."""
    by_block = postings.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "keys"))).alias("postings"))
    answers = [F.struct(F.lit(name).alias("rule"), _postings(q).alias("keys")) for name, q in queries.items()]
    hits = by_block.select(F.explode(F.array(*answers)).alias("a")).select("a.rule", F.explode("a.keys").alias("key"))
    return hits.groupBy("key").agg(F.collect_set("rule").alias("rules"))


def java_regex(rule: Rule) -> str:
    return rule.regex.replace("((?i)password|passwd|secret|token|api_?key)", "((?i:password|passwd|secret|token|api_?key))")


def _search(rule: Rule) -> tuple[str, int]:
    """The regex to look for, and the characters that a match of it still has to be checked for.

    A run of one class, alone or after fixed letters of that class, is as long as it can be wherever it begins, so its
    least length may stand in the regex and short runs make no match at all.
    """
    if rule.group == 0 and rule.least and rule.regex.endswith("]+"):
        head = rule.regex[: rule.regex.index("[")]
        return f"{rule.regex[:-1]}{{{max(1, rule.least - len(head))},}}", 0
    return java_regex(rule), rule.least


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, as a lambda's argument is."""
    return F.transform(F.array(value), f)[0]


def _scanned(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """Running sums or maxima of an array. Each round merges every element with the one 2^k before it: n log n steps."""

    def step(acc: Column, k: Column) -> Column:
        back = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(acc, lambda x, i: F.when(i >= back, merge(x, F.get(acc, i - back))).otherwise(x))

    rounds = lambda v: F.when(F.size(v) > 1, F.sequence(F.lit(0), F.ceil(F.log2(F.size(v))).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return _once(values, lambda v: F.reduce(rounds(v), v, step))


def _found(rule: Rule, text: Column) -> Column:
    """Spans of one rule: the gaps between matches and the matches themselves give the positions."""
    rx, least = _search(rule)
    matches = F.regexp_extract_all(text, F.lit(rx), F.lit(0))
    gaps = F.split(text, rx, -1)
    part = matches if rule.group == 0 or not least else F.regexp_extract_all(text, F.lit(rx), F.lit(rule.group))
    sizes = F.zip_with(F.slice(gaps, F.lit(1), F.size(gaps) - 1), F.arrays_zip(matches.alias("m"), part.alias("p")), lambda g, z: F.struct((F.char_length(g) + F.char_length(z["m"])).alias("step"), F.char_length(z["m"]).alias("size"), F.char_length(z["p"]).alias("part")))

    def spans(x: Column) -> Column:
        ends = _scanned(F.transform(x, lambda z: z["step"]), lambda a, b: a + b)
        both = F.zip_with(ends, x, lambda e, z: F.struct((e - z["size"]).alias("start"), e.alias("end"), z["part"].alias("part")))
        return F.filter(both, lambda z: z["part"] >= least) if least else both

    return _once(sizes, spans)


def _tagged(spans: Column, order: int, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def with_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES, block_docs: int = 4096, name: str = "spans") -> DataFrame:
    """docs with a column of spans added: array of (start, order of the kind, end, kind), sorted."""
    queries = {r.kind: trigram_query(r.regex) for r in rules}
    indexed = {k: q for k, q in queries.items() if q is not None}
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    d = docs.select(row.alias("__row"), doc_key().alias("__key"), F.coalesce("text", F.lit("")).alias("__text"))
    if indexed:
        vocabulary = sorted(set().union(*map(trigrams, indexed.values())))
        found = candidates(index(docs.select("doc_id", "text"), vocabulary, block_docs), indexed).select(F.col("key").alias("__k"), F.col("rules").alias("__rules"))
        d = d.join(found.hint("shuffle_hash"), F.col("__key") == F.col("__k"), "left")
    else:
        d = d.withColumn("__rules", F.lit(None).cast("array<string>"))
    parts = []
    for order, r in enumerate(rules):
        if r.kind in indexed:
            wanted = F.coalesce(F.array_contains("__rules", r.kind), F.lit(False))
        else:  # scanned in full; the plain test spares texts without a match the work on positions
            wanted = F.col("__text").rlike(_search(r)[0])
        one = F.when(wanted, _tagged(_found(r, F.col("__text")), order, r.kind))
        parts.append(F.coalesce(one, F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")))
    return d.select("__row", F.array_sort(F.concat(*parts)).alias("__spans")).select("__row.*", F.col("__spans").alias(name))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


BLOCK = 4096


def _redacted(text: Column, spans: Column) -> Column:
    """The text with one placeholder for each run of overlapping spans, in time linear in the text but for the running maximum.

    The text is cut into blocks of BLOCK code points first, so that a piece is read from its own blocks only.
    """
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))

    def piece(blocks: Column, a: Column, b: Column) -> Column:
        first = F.floor(a / BLOCK).cast("int")
        own = F.array_join(F.slice(blocks, first + 1, F.floor((b - 1) / BLOCK).cast("int") - first + 1), "")
        return F.when(b > a, F.substring(own, a - first * BLOCK + 1, b - a)).otherwise(F.lit(""))

    def pieces(blocks: Column, reach: Column) -> Column:
        # reach: how far the spans up to each one go; a span that starts there or later opens a new mark
        zipped = F.zip_with(F.transform(spans, lambda s: s["start"]), F.concat(F.array(F.lit(0)), F.slice(reach, F.lit(1), F.size(reach) - 1)), lambda s, r: F.struct(r.alias("a"), s.alias("b")))
        kept = F.transform(F.filter(zipped, lambda z: z["b"] >= z["a"]), lambda z: piece(blocks, z["a"], z["b"]))
        return F.concat(kept, F.array(piece(blocks, F.element_at(reach, -1), F.char_length(text))))

    return _once(blocks, lambda bl: _once(_scanned(F.transform(spans, lambda s: s["end"]), F.greatest), lambda r: F.array_join(pieces(bl, r), "[secret]")))


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with each secret in text replaced by a placeholder; overlapping spans are one."""
    d = with_spans(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text"), rules, name="spans")
    done = F.when(F.size("spans") > 0, _redacted(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    return d.select("row", done.alias("text")).select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def query(docs: DataFrame) -> DataFrame:
    d = with_spans(docs.select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["order"] < len(BASE))
    return d.select("doc_id", *[count(r.kind).alias(f"n_{r.kind}") for r in BASE], F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
