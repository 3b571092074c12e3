"""Personal data by weak supervision, in DataFrame functions only.

One scan finds candidate spans: the valid matches of the four base patterns and, in what those leave of the text, looser ones
of the same kinds and secrets (keys, tokens, passwords). Labelers vote on each candidate or abstain: by pattern, by shape, by
gazetteer, by context words and by what stands beside it. Votes and a few features of the span that no labeler looks at are
counted by pattern (a bounded table). Over the votes expectation-maximisation estimates each labeler's reliability per kind
and a posterior per pattern; the final span classifier, a logistic regression on features and votes, is trained on the
posteriors. Valid base spans are always returned; other candidates if the classifier is sure of them.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import save

#: The kinds of the base patterns, and all kinds.
KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
#: Base patterns. Where a run of characters can only match from its first one, a look-behind (or the end of the last match)
#: keeps the search from trying the others; possessive repeats keep it from backtracking. Both leave the matches as they are.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser candidates.
LOOSE = {
    "email": r"(?i)\b[a-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]) ?[a-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\.) ?[a-z0-9-]{1,63}){1,4}",
    "card": BASE["card"],
    "phone": r"(?<![0-9+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])",
    "secret": r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}+",
}
#: What any match holds, where a search for it is cheaper than the pattern; fixed values.
HOLDS = {"email": ("@",), "phone": ("+",), "loose_email": ("(at)", "[at]", "(AT)", "[AT]", "(At)", "[At]", "(aT)", "[aT]")}
#: Top-level domains, card issuers' first digits and country codes; fixed values.
DOMAINS = "com org net edu gov mil int info biz io co de fr es it nl uk us ca ch at be pl se no fi dk eu ru jp cn br in au example test"
COUNTRY = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
CUES = {
    "email": r"(?i)mail|contact|correo|kontakt|courriel|write to|@",
    "ip": r"(?i)\bip\b|host|server|addr|client|login|from",
    "card": r"(?i)card|visa|master|amex|credit|karte|carte|tarjeta|pay",
    "phone": r"(?i)phone|tel|call|mobile|fax|cell|telefon|contact|whatsapp",
    "secret": r"(?i)(?:token|secret|passw(?:or)?d|passphrase|pwd|key|credentials?|auth|bearer)[\"']?(?: is)?[\s=:]{0,4}[\"']?$",
}
#: Formats of well-known keys.
FORMATS = r"^(?:AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk[-_][A-Za-z0-9_-]{20,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{16,})$"
COUNTER = r"(?i)version|\bv\.? ?$|isbn|issn|order|invoice|token|hash|sha|uuid|[0-9a-f]$|\bid\b"
VOTES = ("strict", "shape", "gazetteer", "cue", "edge")
#: How sure the classifier must be to add a span.
SURE = 0.95
CONTEXT = 40
#: Matches whose places are summed up at a time.
BLOCK = 128
#: Bounds of a span's features: length, share of digits in percent, characters that are neither letters nor digits; and what
#: may stand before it.
BINS = {"f_size": (10, 14, 18, 24, 36), "f_digits": (1, 25, 50, 80), "f_marks": (1, 2, 4)}
BESIDE = (r"[A-Za-z]$", r"[0-9]$", r"[\"'`]$", r"[=:]\s?$")
FEATURES = (*BINS, "f_beside")


def _blocks(rows: DataFrame, names: Iterable[str]) -> DataFrame:
    """With blocks_{name}: in blocks, the lengths of a pattern's matches and of the gaps before them.

    Each column is referred to twice by the next one, so that none is merged into a lambda and made anew for each element."""

    def sizes(n: str) -> Column:
        one = lambda i: F.struct(F.char_length(F.get(F.col(f"gaps_{n}"), i)).alias("gap"), F.char_length(F.get(F.col(f"found_{n}"), i)).alias("size"))
        return F.when(F.size(f"found_{n}") > 0, F.transform(F.sequence(F.lit(0), F.size(f"found_{n}") - 1), one)).otherwise(F.array().cast("array<struct<gap:int,size:int>>"))

    def blocks(n: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(f"sizes_{n}") - 1) / BLOCK).cast("int")), lambda b: F.slice(F.col(f"sizes_{n}"), b * BLOCK + 1, BLOCK))

    rows = rows.withColumns({f"sizes_{n}": sizes(n) for n in names})
    return rows.withColumns({f"blocks_{n}": F.when(F.size(f"sizes_{n}") > 0, blocks(n)).otherwise(F.array().cast("array<array<struct<gap:int,size:int>>>")) for n in names})


def _spans(name: str, kind: str, base: bool) -> Column:
    """A pattern's matches, which lie between gaps, as structs: kind, base, start and end in code points, text, text beside it.

    Places are sums of lengths, first over blocks of matches and then within each, so many matches in a text stay cheap."""
    found, gaps, blocks = (F.col(f"{c}_{name}") for c in ("found", "gaps", "blocks"))
    length = lambda block: F.aggregate(block, F.lit(0), lambda n, x: n + x["gap"] + x["size"])
    firsts = F.aggregate(F.transform(blocks, length), F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))

    def places(block: Column, first: Column) -> Column:
        start = F.struct(first.alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
        return F.aggregate(F.coalesce(block, F.array().cast("array<struct<gap:int,size:int>>")), start, lambda acc, x: F.struct((acc["at"] + x["gap"] + x["size"]).alias("at"), F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["size"]).alias("end")))).alias("out")))["out"]

    def whole(place: Column, i: Column) -> Column:
        return F.struct(F.lit(ALL_KINDS.index(kind)).alias("k"), F.lit(base).alias("base"), place["start"].alias("start"), place["end"].alias("end"), F.get(found, i).alias("hit"), F.right(F.get(gaps, i), F.lit(CONTEXT)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(4)).alias("after"))

    return F.when(F.size(found) > 0, F.transform(F.flatten(F.zip_with(blocks, firsts, places)), whole)).otherwise(F.array().cast("array<struct<k:int,base:boolean,start:int,end:int,hit:string,before:string,after:string>>"))


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the Luhn sum of the digits is a multiple of ten."""

    def value(d: Column, i: Column) -> Column:
        n = d.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return n - F.when(n > 9, 9).otherwise(0)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda a, n: a + F.coalesce(n, F.lit(0))) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    n = F.char_length(_digits(hit))
    if kind == "ip":
        return F.forall(F.split(hit, "\\."), lambda p: (F.char_length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.try_to_number(F.right(p, F.lit(3)), F.lit("999")), F.lit(0)) <= 255))
    if kind == "card":
        return n.between(13, 19) & F.when(n.between(13, 19), _luhn(_digits(hit))).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _vote(yes: Column, no: Column | None = None) -> Column:
    return F.when(yes, 1).when(F.lit(True) if no is None else no, -1).otherwise(0)


def _votes(kind: str, base: bool, c: Column) -> dict[str, Column]:
    hit, digits = c["hit"], _digits(c["hit"])
    like = lambda pattern: F.regexp_like(hit, F.lit(pattern))
    mixed = like("[0-9]") & like("[A-Za-z]")
    strict = {"card": _vote(_valid("card", hit)), "secret": _vote(like(FORMATS), ~mixed)}.get(kind, F.lit(1 if base else 0))
    shape = {
        "email": like(r"(?i)(?:\.|dot[)\]]) ?[a-z]{2,24}$"),
        "ip": ~like(r"(?:^|\.)0[0-9]"),
        "card": like(r"^(?:[0-9]{13,19}|[0-9]{4}(?:([ -])[0-9]{4})(?:\1[0-9]{4}){2}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})$"),
        "phone": F.char_length(digits).between(9, 13) & like("[ ().-]"),
        "secret": like(r"[0-9][A-Za-z_+/-]*[0-9][A-Za-z_+/-]*[0-9]") & ~like(r"[a-z]{7}|[/_-].*[/_-].*[/_-]"),
    }[kind]
    known = {
        "email": _vote(like(f"(?i)[.\\])] ?(?:{'|'.join(DOMAINS.split())})$")),
        "ip": _vote(~like(r"^(?:0|22[4-9]|23[0-9]|24[0-9]|25[0-9])\.")),
        "card": _vote(F.regexp_like(digits, F.lit("^[3-6]"))),
        "phone": _vote(like(COUNTRY)) if base else _vote(like(r"^\(?[2-9][0-9]{2}\)?[ .-][2-9]")),
        "secret": _vote(like(r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})$|^(?:AKIA|ASIA|gh[pousr]_|xox[abprs]-|sk[-_]|AIza|eyJ)"), ~mixed),
    }[kind]
    edge = F.regexp_like(c["before"], F.lit(r"[A-Za-z0-9_/+]$" if kind == "secret" else r"[A-Za-z0-9_=/+]$")) | F.regexp_like(c["after"], F.lit(r"^[A-Za-z0-9_=/]"))
    return {"strict": strict, "shape": _vote(shape), "gazetteer": known, "cue": _vote(F.regexp_like(c["before"], F.lit(CUES[kind])), F.regexp_like(c["before"], F.lit(COUNTER))), "edge": _vote(~edge)}


def _features(c: Column) -> dict[str, Column]:
    """What the classifier sees of a span beside the votes: small numbers."""
    n = F.char_length(c["hit"])
    digits = F.char_length(_digits(c["hit"]))
    given = {"f_size": n, "f_digits": F.floor(100 * digits / F.greatest(n, F.lit(1))), "f_marks": F.char_length(F.regexp_replace(c["hit"], "[A-Za-z0-9]", ""))}
    out = {f: sum(((given[f] >= bound).cast("int") for bound in bounds), F.lit(0)) for f, bounds in BINS.items()}
    beside = F.lit(0)
    for k, pattern in reversed(list(enumerate(BESIDE, 1))):
        beside = F.when(F.regexp_like(c["before"], F.lit(pattern)), k).otherwise(beside)
    return out | {"f_beside": beside}


def _candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): per row the candidates with their votes and features, without texts. Only base spans overlap others."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    none = F.array().cast("array<string>")

    def searched(rows: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
        # Columns of their own, so that the lambdas refer to what was found once.
        def may(name: str, pattern: str) -> Column:
            holds = [F.contains(F.col(text), F.lit(x)) for x in HOLDS.get(name, ())]
            return reduce(lambda a, b: a | b, holds) & F.regexp_like(text, F.lit(pattern)) if holds else F.regexp_like(text, F.lit(pattern))

        rows = rows.withColumns({f"found_{n}": F.when(may(n, p), F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none) for n, p in patterns.items()})
        return rows.withColumns({f"gaps_{n}": F.when(F.size(f"found_{n}") > 0, F.split(text, p, -1)).otherwise(none) for n, p in patterns.items()})

    def masked(text: str, kind: str) -> Column:
        """The text with the kind's valid base spans made blank, at its length."""
        found, gaps = F.col(f"found_{kind}"), F.col(f"gaps_{kind}")
        blank = lambda i: F.when(_valid(kind, F.get(found, i)), F.repeat(F.lit("\x00"), F.char_length(F.get(found, i)))).otherwise(F.get(found, i))
        parts = F.transform(F.sequence(F.lit(0), F.size(found)), lambda i: F.concat(F.get(gaps, i), F.when(i < F.size(found), blank(i)).otherwise("")))
        return F.when(F.size(found) > 0, F.array_join(parts, "")).otherwise(F.col(text))

    rows = searched(rows, "text", BASE)
    # Overlapping base spans of two kinds are blank where either is: of each kind's mask the blank characters count.
    rows = rows.withColumn("rest", F.when(sum((F.size(f"found_{k}") for k in KINDS), F.lit(0)) == 0, F.col("text")))
    rows = rows.withColumns({f"mask_{k}": F.when(F.col("rest").isNull(), masked("text", k)) for k in KINDS})
    several = sum(((F.col(f"mask_{k}") != F.col("text")).cast("int") for k in KINDS), F.lit(0))
    characters = lambda k: F.regexp_extract_all(F.col(f"mask_{k}"), F.lit("(?s)."), F.lit(0))
    merged = F.array_join(reduce(lambda a, k: F.zip_with(a, characters(k), lambda x, y: F.when(y == "\x00", y).otherwise(x)), KINDS[1:], characters(KINDS[0])), "")
    one = reduce(lambda a, k: F.when(F.col(f"mask_{k}") != F.col("text"), F.col(f"mask_{k}")).otherwise(a), KINDS, F.col("text"))
    rows = rows.withColumn("rest", F.coalesce("rest", F.when(several <= 1, one).otherwise(merged)))
    rows = searched(rows, "rest", {f"loose_{k}": p for k, p in LOOSE.items()})

    def voted(kind: str, base: bool, found: Column) -> Column:
        given = lambda c: F.struct(c["k"].alias("k"), c["base"].alias("base"), c["start"].alias("start"), c["end"].alias("end"), *[v.alias(n) for n, v in (_votes(kind, base, c) | _features(c)).items()])
        return F.transform(F.filter(found, lambda c: _valid(kind, c["hit"])) if base else found, given)

    patterns = {k: (k, True) for k in KINDS} | {f"loose_{k}": (k, False) for k in LOOSE}
    rows = _blocks(rows, patterns)
    return rows.select("doc_id", F.concat(*[voted(k, base, _spans(n, k, base)) for n, (k, base) in patterns.items()]).alias("spans"))


def estimate(counts: Iterable[tuple[int, tuple[int, ...], int]], rounds: int = 50) -> dict[tuple[int, tuple[int, ...]], float]:
    """Posterior of each (kind, votes) by expectation-maximisation over labelers that are independent given the truth."""
    out = {}
    by_kind: dict[int, list] = {}
    for k, votes, n in counts:
        by_kind.setdefault(k, []).append((votes, n))
    for k, rows in by_kind.items():
        share, right = 0.5, [[0.8, 0.8] for _ in VOTES]  # share of true spans; how often a vote is right on true, on false ones
        for _ in range(rounds):
            posts = []
            for votes, _n in rows:
                yes, no = math.log(share), math.log(1 - share)
                for (a, b), v in zip(right, votes, strict=True):
                    if v:
                        yes, no = yes + math.log(a if v > 0 else 1 - a), no + math.log(1 - b if v > 0 else b)
                posts.append(1 / (1 + math.exp(max(-60.0, min(60.0, no - yes)))))
            weight = sum(n for _, n in rows)
            share = (1 + sum(p * n for p, (_, n) in zip(posts, rows, strict=True))) / (2 + weight)
            for j in range(len(VOTES)):
                cast = [(p, votes[j], n) for p, (votes, n) in zip(posts, rows, strict=True) if votes[j]]
                a = (4 + sum(p * n for p, v, n in cast if v > 0)) / (5 + sum(p * n for p, _, n in cast))
                b = (4 + sum((1 - p) * n for p, v, n in cast if v < 0)) / (5 + sum((1 - p) * n for p, _, n in cast))
                right[j] = [min(max(a, 0.01), 0.99), min(max(b, 0.01), 0.99)]
        out |= {(k, votes): p for p, (votes, _) in zip(posts, rows, strict=True)}
    return out


def _inputs(votes: tuple[int, ...], features: tuple[int, ...]) -> list[tuple[str, float]]:
    return [*zip(VOTES, votes, strict=True), *((f"{n}={v}", 1.0) for n, v in zip(FEATURES, features, strict=True)), ("bias", 1.0)]


def fit(counts: list[tuple[int, tuple[int, ...], tuple[int, ...], int]], steps: int = 300) -> dict[int, dict[str, float]]:
    """From (kind, votes, features, how many) per kind the weights of a logistic regression on votes and features, trained on
    the posteriors that the votes alone yield."""
    by_votes: Counter = Counter()
    for k, votes, _, n in counts:
        by_votes[k, votes] += n
    posterior, out = estimate([(k, votes, n) for (k, votes), n in by_votes.items()]), {}
    for kind in sorted({k for k, *_ in counts}):
        rows = [(_inputs(votes, features), posterior[k, votes], n) for k, votes, features, n in counts if k == kind]
        total, w = sum(n for *_, n in rows), dict.fromkeys((name for x, *_ in rows for name, _ in x), 0.0)
        for _ in range(steps):
            slope = {name: 1e-3 * v for name, v in w.items()}
            for x, target, n in rows:
                z = sum(w[name] * v for name, v in x)
                e = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - target) * n / total
                for name, v in x:
                    slope[name] += e * v
            w = {name: v - 1.0 * slope[name] for name, v in w.items()}
        out[kind] = w
    return out


def find_personal_data(docs: DataFrame, sure: float = SURE) -> DataFrame:
    """Return (doc_id, base, spans) for each row of docs (doc_id, text): arrays of structs (k, start, end), k by ALL_KINDS, in
    code points with the end exclusive, ordered by kind and start. base has the valid matches of the base patterns, spans those
    and what the method adds, which never overlaps a base span.

    A null text is an empty one. Repeated rows get equal results. Without candidates both arrays are empty, and so they are
    in an empty table's empty result.
    """
    found = save(_candidates(docs), "pii-candidates")
    by = [*VOTES, *FEATURES]
    # A row per pattern of votes and features: at most 3^5 times 600 a kind, as long as the corpus may be.
    rows = found.select(F.explode("spans").alias("s")).groupBy("s.k", *[f"s.{v}" for v in by]).agg(F.count("*").alias("n")).orderBy("k", *by).collect()
    weights = fit([(r.k, tuple(r[v] for v in VOTES), tuple(r[v] for v in FEATURES), r.n) for r in rows])

    def scored(s: Column, w: dict[str, float]) -> Column:
        out = F.lit(w["bias"])
        for v in VOTES:
            out = out + F.lit(w.get(v, 0.0)) * s[v]
        for f in FEATURES:
            steps = [(int(name.split("=")[1]), value) for name, value in w.items() if name.startswith(f"{f}=")]
            out = out + reduce(lambda a, x: F.when(s[f] == x[0], F.lit(x[1])).otherwise(a), steps, F.lit(0.0))
        return out

    score = lambda s: F.coalesce(*[F.when(s["k"] == k, scored(s, w)) for k, w in sorted(weights.items())], F.lit(-9.0))
    bare = lambda s: F.struct(s["k"].alias("k"), s["start"].alias("start"), s["end"].alias("end"))
    base = F.transform(F.filter("spans", lambda s: s["base"]), bare)
    added = F.transform(F.filter("spans", lambda s: ~s["base"] & (score(s) >= math.log(sure / (1 - sure)))), bare)
    return found.select("doc_id", F.sort_array(base).alias("base"), F.sort_array(F.concat(base, added)).alias("spans"))


def listed(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in ALL_KINDS])
    return F.array_join(F.transform(F.col(spans), lambda s: F.concat_ws(":", F.get(kinds, s["k"]), s["start"], s["end"])), ",")


def counted(spans: str, kind: str) -> Column:
    return F.size(F.filter(F.col(spans), lambda s: s["k"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
