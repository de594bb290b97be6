"""Secret scan with a trigram inverted index, in Spark SQL expressions only.

From each rule's regular expression a Boolean query over trigrams is derived (the
analysis of Cox, Regular Expression Matching with a Trigram Index, 2012). The
index holds, for every trigram that some rule needs, the posting list of the texts
that contain it; a text is named by its 64-bit hash, so copies have one entry. Lists
are cut into blocks of hashes, each with a bounded number of texts, so that a
frequent trigram's list never lies in one place. Intersections and unions of posting
lists answer the queries, block by block, and only the texts that answer a rule's
query are verified with the expression itself. A rule from which no mandatory
trigram follows is verified on every text.

The index folds case, and two texts of one hash share their postings: a query may
admit more texts than an exact one, never fewer.
"""

from __future__ import annotations

import math
import re._constants as sre
import re._parser as sre_parse
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.sizes import BROADCAST_BYTES
from .components import Scratch

#: At most so many strings are followed exactly; more are cut to their ends.
MOST_STRINGS = 48
#: Posting bits in one number.
BITS = 62
#: Texts of one block of the index, about.
BLOCK_TEXTS = 8192
#: Bytes that a broadcast candidate takes, at most.
CANDIDATE_BYTES = 64


@dataclass(frozen=True)
class Rule:
    """``min_length`` is asked of group ``group`` (0: the whole match); matches that fail are dropped."""

    kind: str
    pattern: str
    group: int = 0
    min_length: int = 1


def either_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([*map(either_case, ("password", "passwd", "secret", "token")), either_case("api") + "_?" + either_case("key")])

#: The base rules, in the order of their kinds.
BASE_RULES = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)

#: Further published token formats.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("repository_token", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abeoprs]-[A-Za-z0-9-]{10,}"),
    Rule("payment_key", r"[rs]k_live_[A-Za-z0-9]{20,}"),
    Rule("map_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

ALL_RULES = BASE_RULES + MORE_RULES


# --- queries over trigrams: True (anything), or ("and" | "or", frozenset of parts), or a trigram ---


def _all_of(*parts):
    flat = set()
    for p in parts:
        if p is True:
            continue
        flat |= p[1] if isinstance(p, tuple) and p[0] == "and" else {p}
    return True if not flat else next(iter(flat)) if len(flat) == 1 else ("and", frozenset(flat))


def _any_of(*parts):
    flat = set()
    for p in parts:
        if p is True:
            return True
        flat |= p[1] if isinstance(p, tuple) and p[0] == "or" else {p}
    asked = {p: {p} if isinstance(p, str) else p[1] for p in flat}
    flat = {p for p in flat if not any(q != p and asked[q] < asked[p] for q in flat)}  # a wider clause says it already
    return next(iter(flat)) if len(flat) == 1 else ("or", frozenset(flat))


def _strings_query(strings: frozenset[str]):
    """What holds of a text that contains one of these strings."""
    if not strings or min(map(len, strings)) < 3:
        return True
    return _any_of(*[_all_of(*{s[i : i + 3] for i in range(len(s) - 2)}) for s in strings])


@dataclass(frozen=True)
class _Part:
    """What is known of the strings a part of an expression matches."""

    exact: frozenset[str] | None  # all of them, if few
    prefix: frozenset[str]
    suffix: frozenset[str]
    query: object

    def whole(self):
        return _all_of(self.query, _strings_query(self.exact)) if self.exact is not None else self.query


_EMPTY = frozenset([""])


def _exact(strings) -> _Part:
    strings = frozenset(strings)
    if len(strings) <= MOST_STRINGS:
        return _Part(strings, strings, strings, True)
    return _Part(None, _cut(strings, True), _cut(strings, False), _strings_query(strings))


def _cut(strings, front: bool) -> frozenset[str]:
    """Shortened to their first or last two letters, or to nothing if they are still many."""
    if len(strings) > MOST_STRINGS:
        strings = frozenset(s[:2] if front else s[-2:] for s in strings)
    return strings if len(strings) <= MOST_STRINGS else _EMPTY


_ANY = _Part(None, _EMPTY, _EMPTY, True)


def _concat(x: _Part, y: _Part) -> _Part:
    if x.exact is not None and y.exact is not None and len(x.exact) * len(y.exact) <= MOST_STRINGS:
        return _exact(a + b for a, b in product(x.exact, y.exact))
    left = x.exact if x.exact is not None else x.suffix
    right = y.exact if y.exact is not None else y.prefix
    seam = True
    if len(left) * len(right) <= 4 * MOST_STRINGS:
        seam = _strings_query(frozenset(a + b for a, b in product(left, right)))
    prefix = _cut(frozenset(a + b for a, b in product(x.exact, right)), True) if x.exact is not None and len(x.exact) * len(right) <= MOST_STRINGS else x.prefix
    suffix = _cut(frozenset(a + b for a, b in product(left, y.exact)), False) if y.exact is not None and len(left) * len(y.exact) <= MOST_STRINGS else y.suffix
    return _Part(None, prefix, suffix, _all_of(x.whole(), y.whole(), seam))


def _either(parts: list[_Part]) -> _Part:
    if all(p.exact is not None for p in parts):
        return _exact(frozenset().union(*[p.exact for p in parts]))
    union = lambda xs: frozenset().union(*xs)
    return _Part(None, _cut(union(p.prefix for p in parts), True), _cut(union(p.suffix for p in parts), False), _any_of(*[p.whole() for p in parts]))


def _of_class(items) -> _Part:
    letters: set[str] = set()
    for op, value in items:
        if op is sre.LITERAL:
            letters.add(chr(value).lower())
        elif op is sre.RANGE and value[1] - value[0] < 128:
            letters |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return _ANY
    return _exact(letters) if len(letters) <= 12 else _ANY


def _of_tree(tree) -> _Part:
    out = _exact([""])
    for op, value in tree:
        if op is sre.LITERAL:
            part = _exact([chr(value).lower()])
        elif op is sre.IN:
            part = _of_class(value)
        elif op is sre.SUBPATTERN:
            part = _of_tree(value[-1])
        elif op is sre.BRANCH:
            part = _either([_of_tree(x) for x in value[1]])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            least, most, body = value
            one = _of_tree(body)
            if least == 0:
                part = _either([_exact([""]), one]) if most == 1 else _ANY
            elif least == most == 1:
                part = one
            else:
                part = one
                for _ in range(min(least, 3) - 1):
                    part = _concat(part, one)
                if most != least or least > 3:
                    part = _Part(None, part.prefix, part.suffix, part.whole())
        elif op is sre.AT:
            continue
        else:
            part = _ANY
        out = _concat(out, part)
    return out


def trigram_query(pattern: str):
    """The Boolean trigram query that every match of ``pattern`` implies; True where none does."""
    return _of_tree(sre_parse.parse(pattern)).whole()


def trigrams(query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


# --- the index and its use ---


def posting_bits(text: str, grams: list[str], queries: list | None = None) -> str:
    """SQL array<bigint>: which of ``grams`` a text contains, one bit each, BITS to a number.

    With ``queries``, a trigram of a conjunction is looked for only in texts that have those before it there:
    a text that lacks one is in no intersection of their lists, whether it has the others or not.
    """
    words = []
    for k in range(0, max(len(grams), 1), BITS):
        place = {g: i for i, g in enumerate(grams[k : k + BITS])}
        told = [_bits_of(q, place) for q in (grams if queries is None else queries) if q is not True]
        words.append(" | ".join(x for x in told if x) or "0L")
    return f"transform(array(lower({text})), t -> array({', '.join(words)}))[0]"


#: Letters from frequent to rare in English; what is none counts as rarer still.
LETTERS = "etaoinshrdlcumwfgypbvkjxqz"


def _bits_of(query, place: dict[str, int]) -> str:
    """SQL: the bits of those of the query's trigrams that have a place; empty if none has one."""
    if isinstance(query, str):
        return f"if(contains(t, {_literal(query)}), {1 << place[query]}L, 0L)" if query in place else ""
    if query[0] == "or":
        parts = [x for x in (_bits_of(q, place) for q in query[1]) if x]
        return f"({' | '.join(parts)})" if parts else ""
    # plain trigrams first, the one of the rarest letters before all, each the condition of what follows
    out = " | ".join(x for x in (_bits_of(q, place) for q in query[1] if not isinstance(q, str)) if x)
    for g in sorted((q for q in query[1] if isinstance(q, str)), key=lambda g: (sum(LETTERS.find(c) % 27 for c in g), g)):
        own = [f"{1 << place[g]}L"] if g in place else []
        inside = " | ".join([*own, *([f"({out})"] if out else [])])
        out = f"if(contains(t, {_literal(g)}), {inside}, 0L)" if inside else ""
    return out


def _in_order(queries: list) -> list[str]:
    """All trigrams of the queries, those of one conjunction together."""
    out: dict[str, None] = {}

    def walk(q) -> None:
        if isinstance(q, str):
            out.setdefault(q)
        elif q is not True:
            for x in sorted(q[1], key=str):
                walk(x)

    for q in queries:
        walk(q)
    return list(out)


def _text(column: str) -> str:
    return f"coalesce(cast({column} as string), '')"


def inverted_index(docs: DataFrame, grams: list[str], scratch: Scratch, text_column: str = "text", queries: list | None = None) -> DataFrame:
    """The posting lists of ``grams``: block, and postings, an array with a list of text hashes for every trigram.

    With ``queries`` the lists hold what their answers depend on (see posting_bits).

    Texts are read once, where they lie; what is shuffled is a hash and the bits of its
    trigrams, once for all copies of a task. Blocks grow in number with the texts.
    """
    text = _text(f"`{text_column}`")
    entries = scratch.save(docs.select(F.expr(f"xxhash64({text})").alias("text_key"), F.expr(posting_bits(text, grams, queries)).alias("bits")).distinct())
    blocks = max(1, math.ceil(entries.count() / BLOCK_TEXTS))
    lists = ", ".join(f"transform(filter(e, x -> (x.bits[{i // BITS}] & {1 << i % BITS}L) != 0), x -> x.text_key)" for i in range(len(grams)))
    gathered = (
        entries.where("exists(bits, x -> x != 0)")
        .groupBy(F.expr(f"cast(pmod(text_key, {blocks}L) as int)").alias("block"))
        .agg(F.collect_list(F.struct("text_key", "bits")).alias("e"))
    )
    return scratch.save(gathered.select("block", F.expr(f"array({lists})").alias("postings")))


def answer(query, grams: list[str], postings: str = "postings") -> str:
    """SQL array<bigint>: the intersections, shortest list first, and unions of posting lists that ``query`` asks for."""
    if isinstance(query, str):
        return f"{postings}[{grams.index(query)}]"
    parts = ", ".join(answer(x, grams, postings) for x in sorted(query[1], key=str))
    if query[0] == "or":
        return f"array_distinct(flatten(array({parts})))"
    return f"""transform(array(array_sort(array({parts}), (x, y) -> size(x) - size(y))), l ->
      aggregate(l, l[0], (a, x) -> if(size(a) = 0, a, array_intersect(a, x))))[0]"""


def candidates(index: DataFrame, queries: list, grams: list[str]) -> DataFrame:
    """text_key and rules: a bit for every rule whose query the posting lists of that text answer."""
    found = [f"transform({answer(q, grams)}, k -> named_struct('text_key', k, 'rules', {1 << i}L))" for i, q in enumerate(queries) if q is not True]
    pairs = index.select(F.explode(F.expr(f"flatten(array({', '.join(found)}))")).alias("c"))
    return pairs.groupBy("c.text_key").agg(F.bit_or("c.rules").alias("rules"))


def _literal(s: str) -> str:
    return "'" + "".join(c if c.isalnum() and ord(c) < 128 else f"\\u{ord(c):04x}" for c in s) + "'"


_SPAN = "array<struct<start:int,end:int,rank:int,kind:string>>"


def _spans(rule: Rule, rank: int, condition: str) -> str:
    """SQL: the rule's spans in text ``t`` if the document is a candidate, from the lengths of the matches and of what lies between them."""
    pattern = "'" + rule.pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    probe = pattern
    if rule.group == 0 and rule.min_length > 1 and rule.pattern.endswith("+"):
        # without a shorter match no longer one fails; verifying starts from documents with a long one
        tail = rule.min_length - len(rule.pattern.split("[")[0])
        probe = pattern[:-2] + f"{{{tail},}}'"
    named = f"named_struct('start', a.p + length(g[i]), 'end', a.p + length(g[i]) + length(m[i]), 'rank', {rank}, 'kind', '{rule.kind}')"
    return f"""
    if({condition} and t rlike {probe},
      transform(array(split(t, {probe}, -1)), g ->
      transform(array(regexp_extract_all(t, {probe}, 0)), m ->
      transform(array(regexp_extract_all(t, {probe}, {rule.group})), v ->
        aggregate(sequence(0, size(m) - 1),
          named_struct('p', 0, 'o', cast(array() as {_SPAN})),
          (a, i) -> named_struct('p', a.p + length(g[i]) + length(m[i]),
            'o', if(length(v[i]) >= {rule.min_length}, concat(a.o, cast(array({named}) as {_SPAN})), a.o)),
          a -> a.o))[0])[0])[0],
      cast(array() as {_SPAN}))"""


def scan(docs: DataFrame, rules: tuple[Rule, ...] = ALL_RULES, text_column: str = "text", name: str = "secrets", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` with an array of the secrets' spans: start, end (code points, end exclusive), rank and kind of the rule.

    Per rule the matches are the leftmost ones that don't overlap; spans of
    different rules may. Spans are in order of start, then of the rules. A null or
    empty text has none. Rows and other columns stay as they are (a column called
    like ``name`` is replaced); an empty table stays empty.

    The index is built and asked at once. Its candidates are broadcast while their
    counted number bounds them by ``broadcast_bytes``; beyond it rows are joined with
    them by shuffled hashes, where Spark splits the partition of a frequent text.
    """
    queries = [trigram_query(r.pattern) for r in rules]
    grams = _in_order(queries)
    rows = docs.select(F.expr(f"xxhash64({_text(f'`{text_column}`')})").alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    if grams:
        scratch = Scratch(docs.sparkSession, "trigrams")
        asked = scratch.save(candidates(inverted_index(docs, grams, scratch, text_column, queries), queries, grams))
        scratch.retain(asked)
        if asked.count() * CANDIDATE_BYTES <= broadcast_bytes:
            asked = F.broadcast(asked)
        rows = rows.join(asked, F.col("key") == F.col("text_key"), "left")
    else:
        rows = rows.withColumn("rules", F.lit(0).cast("long"))
    asks = ["true" if q is True else f"(coalesce(rules, 0L) & {1 << i}L) != 0" for i, q in enumerate(queries)]
    found = ", ".join(_spans(r, i, ask) for i, (r, ask) in enumerate(zip(rules, asks, strict=True)))
    spans = F.expr(f"transform(array({_text(f'row.`{text_column}`')}), t -> array_sort(flatten(array({found}))))[0]").alias(name)
    same = [c for c in docs.columns if c.lower() == name.lower()]
    return rows.select(*[spans if c in same else F.col(f"row.`{c}`") for c in docs.columns], *([] if same else [spans]))


def digest_text(spans: str, most_rank: int | None = None) -> Column:
    """kind:start:end of every span, comma-joined."""
    kept = spans if most_rank is None else f"filter({spans}, s -> s.rank < {most_rank})"
    return F.expr(f"array_join(transform({kept}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')")


#: Behind the BEGIN line of a key: SQL for how many characters of ``r`` still belong to it. Through its END line, unless another block
#: begins before; without one, through the base64 block: words of 16 letters or more, then a shorter one that ends a line.
_KEY_REST = r"""
transform(array(locate('-----END ', r)), e ->
transform(array(length(regexp_extract(substring(r, greatest(e, 1)), '^-----END [A-Z ]*PRIVATE KEY-----', 0))), n ->
  if(e > 0 and n > 0 and locate('-----BEGIN ', substring(r, 1, e)) = 0, e - 1 + n,
    transform(array(if(regexp_instr(r, '(?<!\\S)(?![A-Za-z0-9+/=]{16,}(?!\\S))\\S') = 0, length(r) + 1, regexp_instr(r, '(?<!\\S)(?![A-Za-z0-9+/=]{16,}(?!\\S))\\S'))), k ->
      if(trim(substring(r, 1, k - 1)) rlike '\\S', k - 1 + length(regexp_extract(substring(r, k), '^[A-Za-z0-9+/=]{1,15}(?=[ \\t\\r]*(\\n|$))', 0)), 0))[0]))[0])[0]"""


def redact(docs: DataFrame, rules: tuple[Rule, ...] = ALL_RULES, text_column: str = "text", mark: str = "[redacted]") -> DataFrame:
    """``docs`` with every secret, overlapping ones as one, replaced by ``mark``; a null text stays null.

    The span of a private key is its BEGIN line; its body and END line go with it.
    """
    out = scan(docs, rules, text_column, "_secrets")
    t, m = f"`{text_column}`", "'" + mark.replace("\\", "\\\\").replace("'", "\\'") + "'"
    rest = f"transform(array(substring({t}, s.end + 1)), r -> {_KEY_REST})[0]"
    whole = f"named_struct('start', s.start, 'end', cast(s.end + {rest} as int), 'rank', s.rank, 'kind', s.kind)"
    out = out.withColumn("_secrets", F.expr(f"transform(_secrets, s -> if(s.kind = 'private_key', {whole}, s))"))
    clean = F.expr(f"""
      if(size(_secrets) = 0 or {t} is null, {t},
        aggregate(_secrets, named_struct('p', 0, 'o', ''),
          (a, s) -> if(s.end <= a.p, a, named_struct('p', greatest(s.end, a.p),
            'o', if(s.start < a.p, a.o, concat(a.o, substring({t}, a.p + 1, s.start - a.p), {m})))),
          a -> concat(a.o, substring({t}, a.p + 1))))""")
    return out.withColumn(text_column, clean).drop("_secrets")
