"""Personal data by weak supervision, in DataFrame functions only.

Labelers (shape, gazetteer, context) vote on candidate spans; expectation-maximisation estimates how reliable each
labeler is, and its posteriors train a logistic span classifier, which sees features of the span beside the votes. Spans
of the base patterns always stay; the classifier decides on the looser candidates.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import staged, text_of

#: Kinds in the order of a tie.
KINDS = ("email", "ip", "card", "phone", "ssn", "name", "secret")
BASE_KINDS = KINDS[:4]

# Base patterns. Possessive quantifiers and the lookbehinds (or \G, the end of the match before) change no match; they keep
# the engine from trying every suffix of a long run and from deep recursion.
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: Of each kind: the pattern, then literal strings of which a text must hold one (none: a digit), then literals of which
#: its lower-case form may hold one instead. They spare most texts the pattern and, as every match holds one, cost no match.
BASE = {
    "email": (rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++", ("@",)),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ()),
    "card": (r"[0-9](?:[\x20-]?+[0-9])++", ()),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", ("+",)),
}
#: Candidates that no base pattern covers.
LOOSE = {
    "email": (
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\(dot\)|\[dot\]|\x20dot\x20)\x20?[A-Za-z0-9-]{1,63}+)+",
        ("(dot)", "[dot]", " dot "),
    ),
    "phone": (r"(?<![\w+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![\w-])", ()),
    "ssn": (r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])", ()),
    "name": (
        r"\b(?:Mr|Mrs|Ms|Dr|Prof)\.?+\x20\p{Lu}\p{Ll}++(?:\x20\p{Lu}\p{Ll}++)?+|(?i:\bname\x20?(?:is|:)\x20?)\p{Lu}\p{Ll}++\x20\p{Lu}\p{Ll}++",
        ("Mr. ", "Mr ", "Mrs. ", "Mrs ", "Ms. ", "Ms ", "Dr. ", "Dr ", "Prof. ", "Prof "),
        ("name is", "nameis", "name :", "name:"),
    ),
    "secret": (
        r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{36,}+|\bsk-[A-Za-z0-9_-]{20,}+|-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----|(?i:\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)[\"']?\x20?[:=]\x20?[\"']?)[A-Za-z0-9+/_-]{16,}+",
        ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "PRIVATE KEY"),
        ("token", "secret", "passw", "key"),
    ),
}
#: Words just before a span that speak for its kind, and words that speak for something else.
CONTEXT = {
    "email": "mail|contact|write|address", "ip": r"\bip\b|host|server|address|login", "card": "card|visa|credit|payment|account",
    "phone": "phone|tel|call|mobile|fax|contact", "ssn": "ssn|social|security|tax", "name": "name|patient|contact|signed|dear",
    "secret": "token|secret|key|password|auth|bearer|credential|export",
}
AGAINST = r"isbn|issn|version|\bv\.?$|order|invoice|serial|part|doi|build|#\s*$|\$\s*$"
# Gazetteers. Endings of addresses, networks that are never public, issuer prefixes of payment cards, country
# codes of telephone numbers, areas that were never issued, common given names, prefixes of access keys.
ENDINGS = (
    "com org net edu gov mil int info biz name io dev app ai co me tv cc xyz online site shop cloud tech de fr es uk eu it nl ch at be se no dk fi ie pt pl cz sk hu ro bg gr hr si lt lv ee ru ua by tr il ae sa "
    "in pk bd lk cn hk tw jp kr sg my th vn id ph au nz ca us mx br ar cl pe ve za ng ke eg ma"
)
GIVEN_NAMES = (
    "Aaron Adam Ahmed Alan Albert Alejandro Alex Alexander Alice Amanda Amy Ana Andrea Andreas Andrew Angela Anita Ann Anna Anne Anthony Antoine Antonio Arthur Barbara Ben Benjamin Bernard Beth Brian Camille Carl "
    "Carla Carlos Carmen Caroline Catherine Charles Charlotte Chris Christian Christine Christopher Claire Claudia Daniel David Deborah Dennis Diana Diego Dieter Donald Dorothy Edward Elena Elisabeth Elizabeth Emily "
    "Emma Eric Erik Eva Fatima Fernando Francesca Francisco Frank Franz Fred Gabriel George Georg Gerhard Giovanni Giulia Grace Hannah Hans Heidi Helen Helga Henri Henry Hugo Ian Ingrid Isabel Ivan Jack Jacob Jacques "
    "James Jan Jane Janet Jason Javier Jean Jeff Jennifer Jessica Jim Joan Joao Joe Johann John Jonathan Jorge Jose Joseph Juan Judith Julia Julie Karen Karl Kate Katherine Kevin Klaus Kurt Laura Lars Lea Leon Linda "
    "Lisa Louis Louise Lucas Lucia Luigi Luis Lukas Manuel Marco Margaret Maria Marie Mario Mark Marta Martha Martin Mary Matthew Max Michael Michel Miguel Mohamed Monika Nancy Nathalie Nicholas Nicolas Nicole Nina "
    "Olga Oliver Olivia Oscar Otto Pablo Pamela Patricia Patrick Paul Paula Pedro Peter Petra Philip Pierre Rachel Ralph Raul Rebecca Richard Robert Roberto Roger Rosa Ruth Samuel Sandra Sara Sarah Scott Sergio Simon "
    "Sofia Sophie Stefan Stephen Steven Susan Sylvia Teresa Theresa Thomas Tim Timothy Tom Ursula Victor Victoria Vincent Walter Werner William Wolfgang Yasmin"
)
CALLING_CODES = "1 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 7 81 82 84 86 90 91 92 93 94 95 98 212 213 216 218 220 234 254 351 352 353 354 356 357 358 359 370 371 372 380 385 386 420 421 852 880 886 961 962 965 966 971 972 974"
_any = lambda words: "|".join(words.split())
GAZETTEER = {
    "email": rf"(?i)(?:\.|dot[)\]]?\x20?)(?:{_any(ENDINGS)})$", "ip": r"^(?:10|127|192\.168|169\.254|172\.(?:1[6-9]|2[0-9]|3[01]))\.", "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|35|3[068]|6011|65|62)",
    "phone": rf"^(?:\+(?:{_any(CALLING_CODES)})(?![0-9])|\+1|\(?[2-9][0-9]{{2}})", "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)", "name": rf"\b(?:{_any(GIVEN_NAMES)})\b", "secret": r"^(?:AKIA|ASIA|gh[pousr]_|sk-|-----BEGIN)",
}

LABELERS = ("strict shape", "gazetteer", "context for", "context against", "glued to a word", "one digit only")
#: What the classifier sees of a span beside the votes: each is 0 or 1.
FEATURES = ("ten signs or more", "twenty signs or more", "digits are half of it or more", "holds a separator", "holds a lower-case letter", "holds an upper-case letter", "ends a line or sentence", "three different digits at most")
N, M = len(LABELERS), len(FEATURES)
EM_STEPS, FIT_STEPS, RATE = 30, 300, 0.5


#: Code points before and after a span that labelers and features look at, and spans that a block of _ends holds.
BEFORE, AFTER, BLOCK = 24, 2, 256


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def _ends(lengths: Column) -> Column:
    """Running sums, in blocks: appending to one long array would copy it for every match."""
    sums = lambda xs, start: F.aggregate(xs, F.struct(start.alias("at"), F.array().cast("array<int>").alias("out")), lambda a, x: F.struct((a["at"] + x).alias("at"), F.array_append(a["out"], a["at"] + x).alias("out")), lambda a: a["out"])
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda i: F.slice(lengths, i * BLOCK + 1, F.lit(BLOCK)))
    totals = lambda blocks: F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x))
    joined = lambda blocks: _let(sums(totals(blocks), F.lit(0)), lambda starts: F.flatten(F.transform(blocks, lambda b, i: sums(b, F.when(i == 0, F.lit(0)).otherwise(F.get(starts, i - 1))))))
    return F.when(F.size(lengths) > 0, _let(cut, joined)).otherwise(F.array().cast("array<int>"))


def _found(text: Column, pattern: str, must: tuple[str, ...], lower: tuple[str, ...] = ()) -> Column:
    """(s, e, m, b, a) of leftmost non-overlapping matches, by code point: each match is taken with the gap before it.

    b and a are the text just before and after the span. They come from the gaps and matches around it, never from the
    text by position, which would be read from its start for every match. A match has two signs at least, so the gaps
    and matches of BEFORE / 2 predecessors hold all that b needs.
    """
    both = rf"(?s)\G(.*?)({pattern})"  # \G: after the last match, no later start scans the rest again
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(both), 1).alias("g"), F.regexp_extract_all(text, F.lit(both), 2).alias("m"))

    def spans(p: Column) -> Column:
        tails = F.transform(p, lambda x: F.concat(F.right(x["g"], F.lit(BEFORE)), F.right(x["m"], F.lit(BEFORE))))
        heads = F.transform(p, lambda x: F.left(F.concat(F.left(x["g"], F.lit(AFTER)), F.left(x["m"], F.lit(AFTER))), F.lit(AFTER)))
        ends = _ends(F.transform(p, lambda x: F.length(x["g"]) + F.length(x["m"])))
        known = F.struct(tails.alias("tails"), heads.alias("heads"), ends.alias("ends"))

        def placed(k: Column) -> Column:
            last = F.substring(text, F.coalesce(F.try_element_at(k["ends"], F.lit(-1)), F.lit(0)) + 1, F.lit(AFTER))

            def one(rest: Column) -> Column:
                def span(x: Column, i: Column) -> Column:
                    first = F.greatest(i - BEFORE // 2, F.lit(0))
                    earlier = F.array_join(F.slice(k["tails"], first + 1, i - first), "")
                    before = F.right(F.concat(earlier, F.right(x["g"], F.lit(BEFORE))), F.lit(BEFORE))
                    end = F.get(k["ends"], i)
                    return F.struct((end - F.length(x["m"])).alias("s"), end.alias("e"), x["m"].alias("m"), before.alias("b"), F.coalesce(F.get(k["heads"], i + 1), rest).alias("a"))

                return F.transform(p, span)

            return _let(last, one)

        return _let(known, placed)

    out = _let(pairs, spans)
    none = F.array().cast("array<struct<s:int,e:int,m:string,b:string,a:string>>")
    holds = [F.contains(text, F.lit(m)) for m in must] + [F.contains(F.lower(text), F.lit(m)) for m in lower]
    return F.when(functools.reduce(lambda a, b: a | b, holds), out).otherwise(none) if holds else out


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return m.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _votes(kind: str, x: Column, strict: bool) -> Column:
    """-1, 0 or 1 of each labeler."""
    before = F.lower(x["b"])
    digits = F.regexp_replace(x["m"], "[^0-9]", "")
    vote = lambda yes, on, otherwise=0: F.when(yes, F.lit(float(on))).otherwise(F.lit(float(otherwise)))
    return F.array(
        F.lit(1.0 if strict else 0.0),
        vote(x["m"].rlike(GAZETTEER[kind]), 1),
        vote(before.rlike(CONTEXT[kind]), 1),
        vote(before.rlike(AGAINST), -1),
        vote(x["a"].rlike(r"^[\p{L}\p{N}_]") | before.rlike(r"[\p{L}\p{N}_]$"), -1),
        vote((F.length(digits) >= 7) & digits.rlike(r"^(.)\1*$"), -1),
    )


def _features(x: Column) -> Column:
    """0 or 1 of each feature."""
    digits = F.regexp_replace(x["m"], "[^0-9]", "")
    after = x["a"]
    found = (
        F.length(x["m"]) >= 10, F.length(x["m"]) >= 20, 2 * F.length(digits) >= F.length(x["m"]), x["m"].rlike(r"[\x20()./_-]"), x["m"].rlike(r"\p{Ll}"), x["m"].rlike(r"\p{Lu}"),
        after.rlike(r"^(?:$|\n|[.,;!?](?:\s|$))"), (F.length(digits) > 0) & (F.size(F.array_distinct(F.split(digits, ""))) <= 3),
    )
    return F.array(*(F.when(f, F.lit(1.0)).otherwise(F.lit(0.0)) for f in found))


def _candidates(text: Column) -> Column:
    """All spans as (s, k, e, base, v: votes, x: features)."""
    shape = "struct<s:int,k:int,e:int,base:boolean,v:array<double>,x:array<double>>"

    def of(k: int, kind: str, strict: bool, pattern: str, must: tuple[str, ...], lower: tuple[str, ...] = ()) -> Column:
        spans = _found(text, pattern, must, lower)
        if strict:
            spans = F.filter(spans, lambda x: _valid(kind, x["m"]))
        return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), F.lit(strict).alias("base"), _votes(kind, x, strict).alias("v"), _features(x).alias("x")).cast(shape))

    sources = [(k, kind, strict, *patterns[kind]) for k, kind in enumerate(KINDS) for patterns, strict in ((BASE, True), (LOOSE, False)) if kind in patterns]
    numeric = F.concat(*(of(*x) for x in sources if not x[4]))
    return F.concat(F.when(text.rlike("[0-9]"), numeric).otherwise(F.array().cast(f"array<{shape}>")), *(of(*x) for x in sources if x[4]))


def with_candidates(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """_doc: the row of docs; _c: base spans, and looser candidates that touch no base span. Written once, for training and finding."""
    text = text_of(text_column)
    raw = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), _candidates(text).alias("_c"))
    base = F.filter("_c", lambda x: x["base"])
    free = F.filter("_c", lambda x: ~x["base"] & ~F.exists(base, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    return staged(raw.withColumn("_c", F.when(F.exists("_c", lambda x: ~x["base"]), F.concat(base, free)).otherwise(F.col("_c"))), "candidates")


def train(found: DataFrame) -> dict[int, list[float]]:
    """Weights of the span classifier, N + M + 1 (votes, features, constant) for each kind that has candidates (_c of found).

    Candidates are counted by kind, votes and features, at most 3 ** N * 2 ** M combinations a kind, and far fewer in
    any text; both fits run over these counts inside one SQL expression, so their cost does not depend on the number
    of documents. Expectation-maximisation sees the votes alone; the classifier learns its posteriors from votes and features.
    """
    patterns = found.select(F.explode("_c").alias("c")).groupBy("c.k", "c.v", "c.x").agg(F.count("*").cast("double").alias("n"))
    kinds = patterns.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("v", "x", "n"))).alias("items"))
    logit = f"ln(s.pi / (1 - s.pi)) + aggregate(sequence(0, {N - 1}), 0D, (a, l) -> a + t.v[l] * ln(s.acc[l] / (1 - s.acc[l])))"
    posts = f"transform(items, t -> named_struct('v', t.v, 'z', concat(t.v, t.x, array(1D)), 'n', t.n, 'p', 1 / (1 + exp(-({logit})))))"
    agree = "aggregate(ps, 1.6D, (a, t) -> a + t.n * CASE WHEN t.v[l] > 0 THEN t.p WHEN t.v[l] < 0 THEN 1 - t.p ELSE 0D END)"
    voted = "aggregate(ps, 2D, (a, t) -> a + CASE WHEN t.v[l] <> 0 THEN t.n ELSE 0D END)"
    share = "aggregate(ps, 1D, (a, t) -> a + t.n * t.p) / aggregate(ps, 2D, (a, t) -> a + t.n)"
    step = f"transform(array({posts}), ps -> named_struct('pi', {share}, 'acc', transform(sequence(0, {N - 1}), l -> greatest(0.5D, {agree} / {voted}))))[0]"
    em = f"aggregate(sequence(1, {EM_STEPS}), named_struct('pi', 0.5D, 'acc', array_repeat(0.8D, {N})), (s, i) -> {step})"
    error = f"(t.p - 1 / (1 + exp(-aggregate(sequence(0, {N + M}), 0D, (a, l) -> a + w[l] * t.z[l]))))"
    slope = "aggregate(ps, 0D, (a, t) -> a + t.n * t.e * t.z[j]) / aggregate(ps, 0D, (a, t) -> a + t.n)"
    fit = f"aggregate(sequence(1, {FIT_STEPS}), array_repeat(0D, {N + M + 1}), (w, i) -> transform(array(transform(ps, t -> named_struct('z', t.z, 'n', t.n, 'e', {error}))), ps -> transform(sequence(0, {N + M}), j -> w[j] + {RATE} * ({slope})))[0])"
    fitted = kinds.withColumn("s", F.expr(em)).withColumn("ps", F.expr(posts)).withColumn("w", F.expr(fit))
    return {r["k"]: list(r["w"]) for r in fitted.select("k", "w").collect()}


def find(docs: DataFrame, text_column: str = "text", model: dict[int, list[float]] | None = None) -> DataFrame:
    """docs with spans, array of (start, kind, end) by start then kind, code points, end exclusive; base: whether a base pattern found it.

    A null or empty text has no spans. Kinds that overlap are both kept, as their patterns found them. Repeated rows,
    null ids and an empty table are no special cases (an empty table trains nothing, and then only base spans count);
    a column named spans gives way, others may have any name. Whole texts are read once; candidates are written beside
    them, and training reads those alone. Nothing is shuffled but counts.
    """
    candidates = with_candidates(docs.drop("spans"), text_column)
    model = train(candidates) if model is None else model

    def accepted(x):
        out = F.lit(False)
        for k, w in sorted(model.items()):
            total = F.lit(w[N + M])
            for j in range(N):
                total = total + F.lit(w[j]) * x["v"][j]
            for j in range(M):
                total = total + F.lit(w[N + j]) * x["x"][j]
            out = out | ((x["k"] == k) & (total >= 0))
        return x["base"] | out

    names = F.array(*map(F.lit, KINDS))
    kept = F.array_sort(F.transform(F.filter("_c", accepted), lambda x: F.struct(x["s"].alias("start"), x["k"].alias("k"), x["e"].alias("end"), x["base"].alias("base"))))
    spans = F.transform(kept, lambda x: F.struct(x["start"].alias("start"), names[x["k"]].alias("kind"), x["end"].alias("end"), x["base"].alias("base")))
    return candidates.select("_doc.*", spans.alias("spans"))


def described(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat(x["kind"], F.lit(":"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_column: str = "text", model: dict[int, list[float]] | None = None) -> DataFrame:
    """docs with every span of the text replaced by its kind in brackets; overlapping spans become one, of the first's kind."""
    found = find(docs, text_column, model)
    text = text_of(text_column)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state, x):
        gap = F.substring(text, state["at"] + 1, F.greatest(x["start"] - state["at"], F.lit(0)))
        return F.struct(F.greatest(state["at"], x["end"]).alias("at"), F.when(x["start"] < state["at"], state["out"]).otherwise(F.concat(state["out"], gap, F.lit("["), F.upper(x["kind"]), F.lit("]"))).alias("out"))

    done = F.aggregate("spans", start, step, lambda x: F.concat(x["out"], F.substring(text, x["at"] + 1, F.length(text))))
    return found.withColumn(text_column, F.when(F.size("spans") > 0, done).otherwise(text)).drop("spans")
