"""Personal data by weak supervision (DataFrame functions only on the executors).

Patterns propose candidate spans: the base ones, which are results as they stand, and wider ones: matches
that fail a base check, national phone numbers of four languages, spelt-out mail addresses, cards with other
separators, IPv6 addresses, and credentials (kind ``secret``). Labelers vote +1, -1 or 0 on every candidate:
pattern checks, gazetteers (domain endings, card issuers, country codes, reserved addresses, key prefixes),
the words around it in four languages, its edges and its form. Expectation-maximisation over the counted vote
patterns of all candidates estimates the reliability of each labeler on each kind, and a posterior for every
pattern. A logistic span classifier is trained on these posteriors, with features of its own that no labeler
sees: length, shape (which separators) and the group of the word before. Wider candidates that it accepts, and
that touch no base span, are added.

Only counts by distinct feature combination reach the driver: at most kinds * sources * 3**labelers * buckets
numbers, however large the corpus. Texts are read once and never shuffled.

Defined results: null text is empty; positions are code points; repeated rows are answered each; an empty
table gives no rows (and an untrained classifier that adds nothing); other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import stored

KINDS = ("email", "ip", "card", "phone")
#: Kinds that have no base pattern.
ALL_KINDS = (*KINDS, "secret")
_LOCAL, _LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"
#: Java patterns that match what the contract's patterns match, in linear time and without deep recursion:
#: a match can only begin where its run begins or the last match ended, and domains and digit runs are
#: extended character by character up to the first place where they cannot go on.
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_LABEL}]++\.(?=[{_LABEL}])[{_LABEL}.]*?(?=\.(?:[^{_LABEL}]|\z)|[^{_LABEL}.]|\z)",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_OPEN, _SHUT = r"[\[({<] ?", r" ?[\])}>]"
WIDE = {
    "email": rf"(?i)(?<![{_LABEL}._])[A-Za-z0-9._-]{{1,64}}+(?: ?{_OPEN}(?:at|ät|arroba|arobase){_SHUT} ?[A-Za-z0-9-]{{1,63}}+(?: ?{_OPEN}(?:dot|punkt|punto|point){_SHUT} ?[A-Za-z0-9-]{{2,63}}+|\.[A-Za-z0-9-]{{2,63}}+){{1,4}}"
    rf"| (?:at|ät|arroba|arobase) [A-Za-z0-9-]{{1,63}}+(?: (?:dot|punkt|punto|point) [A-Za-z0-9-]{{2,63}}+){{1,4}})",
    "ip": r"(?i)(?<![0-9a-z:])(?:(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}|(?:[0-9a-f]{1,4}:){1,6}(?::[0-9a-f]{1,4}){1,6})(?![0-9a-z:.])",
    "card": r"(?<![0-9])(?:[0-9]{4}([./_\x{A0}]|  )[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|3[47][0-9]{2}([./_\x{A0}])[0-9]{6}\2[0-9]{5})(?![0-9])",
    "phone": r"(?<![0-9+])(?<![0-9][ ./-])(?<!\+[0-9]{1,3} )(?:\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}|00[1-9][0-9]{0,2}(?:[ ./-][0-9]{2,4}){2,5}|0[1-9](?:[ .-][0-9]{2}){4}"
    r"|0[1-9][0-9]{1,4}(?: ?/ ?|[ -])(?:[0-9]{5,9}|[0-9]{3,4}[ -][0-9]{3,4})|[689][0-9]{2}(?:(?:[ .-][0-9]{3}){2}|(?:[ .-][0-9]{2}){3}))(?![ ./-]?[0-9])",
    "secret": r"""(?i:password|passwort|passwd|pwd|contraseña|token|secret|api[_-]?key)["']? {0,3}[=:] {0,3}["']?[^\s"',;]{8,128}+["']?|(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{16,64})(?![A-Za-z0-9])|-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----""",
}
#: Cheap tests that a text without candidates fails: a string that it must hold, or a pattern.
HINT = {"email": "@", "ip": ".", "card": None, "phone": "+"}
WIDE_HINT = {
    "email": r"(?i)[\[({<] ?(?:at|ät|ar+ob)| (?:dot|punkt|punto|point) ",
    "ip": r"[0-9A-Fa-f]:[0-9A-Fa-f:]",
    "card": r"[0-9]{4}[./_\x{A0} ]{1,2}[0-9]{4}",
    "phone": r"[0-9]\)?[ ./-]{1,3}[0-9]{2}",
    "secret": r"""[=:] {0,3}["']?[^\s"',;]{8}|AKIA|ASIA|gh[pousr]_|-----BEGIN""",
}
# Gazetteers.
DOMAIN_ENDINGS = (
    "com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "name", "pro", "io", "ai", "app", "dev", "co", "me", "tv", "cloud", "online", "site", "shop", "blog", "test", "example",
    "de", "at", "ch", "fr", "be", "lu", "es", "mx", "ar", "cl", "pe", "uk", "ie", "us", "ca", "au", "nz", "za", "it", "nl", "pt", "br", "pl", "cz", "se", "no", "dk", "fi", "ru", "ua", "jp", "cn", "kr", "in", "tr", "gr", "il", "eu",
)
CARD_ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38)"
COUNTRY_CODES = r"^(?:\+|00)(?:1|7|2[07]|3[0-4]|36|39|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
RESERVED = r"^(?:0|127|255)\.|\.0\.0\.0$"
GLOBAL_V6 = r"(?i)^(?:2[0-9a-f]{3}|fe80|f[cd][0-9a-f]{2}):"
KEY_PREFIXES = r"^(?:AKIA|ASIA|gh[pousr]_|-----BEGIN)"
STAND_INS = r"(?i)example|changeme|your|xxxx|\*\*\*\*|<|\$\{"
# Words that speak for a kind, by group (what is asked for; who or where), in English, German, French and Spanish.
WORDS = {
    "email": (r"e-?mail|mailto|mail|correo|courriel|kontakt|contact|contacto", r"write|escriba|schreib(?:en|t)|écri(?:re|vez)|reach|to|an|à|a"),
    "ip": (r"\bip|host|server|servidor|serveur|rechner|adresse|address|dirección", r"login|from|client|cliente|von|de|depuis|desde"),
    "card": (r"card|visa|master(?:card)?|amex|tarjeta|carte|karte|kreditkarte", r"credit|crédito|crédit|payment|pago|paiement|zahlung"),
    "phone": (r"tel|phone|call|fax|mobile|cell|teléfono|téléphone|telefon|handy|móvil|rufnummer", r"ring|llame|appelez|anruf|reach|text|sms|whatsapp"),
    "secret": (r"login|user|usuario|benutzer|utilisateur|credentials?", r"export|set|config|env"),
}
FOR = {k: rf"(?i)(?:{'|'.join(v)})\W{{0,3}}$" for k, v in WORDS.items()}
AGAINST = r"(?i)(?:version|ver|\bv|release|isbn|issn|order|pedido|commande|bestellung|ref|section|sección|abschnitt|fig|page|seite|página|#|\bno|\bnr|id)\W{0,3}$"
LABELERS = ("check", "gazetteer", "before", "edges", "form")
#: Labelers speak against a candidate only where they have a reason, so such a vote starts with more weight.
AGAINST_COUNTS = 3
CONTEXT = 24
BLOCK = 256


# -- candidates --------------------------------------------------------------------------------------


def _prefix_sums(values: str) -> tuple[Column, Callable[[Column, Column], Column]]:
    """(block sums, i -> sum of the first i values), linear but for one term a block."""
    blocks = F.transform(
        F.sequence(F.lit(0), F.greatest(F.floor((F.size(values) - 1) / BLOCK), F.lit(0)).cast("int")),
        lambda b: F.aggregate(F.slice(values, 1, b * BLOCK), F.lit(0), lambda a, x: a + x),
    )
    return blocks, lambda i, of: F.element_at(of, F.floor(i / BLOCK).cast("int") + 1) + F.aggregate(F.slice(values, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK), F.lit(0), lambda a, x: a + x)


SPAN = "array<struct<start:int,end:int,value:string,before:string,after:string>>"


def located(df: DataFrame, text: str, pattern: str, to: str, some: Column) -> DataFrame:
    """Add ``to``: the leftmost non-overlapping matches with positions and what stands around them, where ``some`` holds."""
    none = lambda kind: F.array().cast(f"array<{kind}>")
    out = df.withColumn("__hits", F.when(some, F.regexp_extract_all(text, F.lit(pattern), 0)).otherwise(none("string")))
    out = out.withColumn("__gaps", F.when(F.size("__hits") > 0, F.split(text, pattern, -1)).otherwise(none("string")))
    out = out.withColumn("__steps", F.zip_with(F.slice("__gaps", 1, F.size("__hits")), "__hits", lambda g, h: F.char_length(g) + F.char_length(h)))
    blocks, upto = _prefix_sums("__steps")
    out = out.withColumn("__blocks", F.when(F.size("__steps") > 0, blocks))

    def span(hit: Column, i: Column) -> Column:
        gap, after = F.element_at("__gaps", i + 1), F.element_at("__gaps", i + 2)
        start = upto(i, F.col("__blocks")) + F.char_length(gap)
        return F.struct(start.alias("start"), (start + F.char_length(hit)).alias("end"), hit.alias("value"), F.right(gap, F.lit(CONTEXT)).alias("before"), F.left(after, F.lit(1)).alias("after"))

    return out.withColumn(to, F.transform("__hits", span).cast(SPAN)).drop("__hits", "__gaps", "__steps", "__blocks")


def digits_of(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of up to 19 digits is right."""

    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 0, d * 2).otherwise(d)
        return total + F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def passes(kind: str, value: Column) -> Column:
    """The base check of a match."""
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.left(p, F.lit(3)).cast("int") <= 255))
    if kind == "card":
        return luhn(digits_of(value))
    if kind == "phone":
        return F.length(digits_of(value)).between(9, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _votes(kind: str, wide: bool, s: Column) -> list[Column]:
    value, digits = s["value"], digits_of(s["value"])
    check = F.lit(0) if wide else F.when(passes(kind, value), 1).otherwise(-1)
    if kind == "email":
        known = F.lower(F.regexp_extract(value, "([A-Za-z]+)$", 1)).isin(*DOMAIN_ENDINGS)
        gazetteer, form = _vote(known, F.lit(wide)), _vote(F.length(value) <= 64, F.length(value) > 128)
        if wide:  # brackets are a disguise, bare words may be a sentence
            form = _vote(value.rlike(r"[\[({<]"), ~value.rlike(r"[0-9._-]"))
    elif kind == "ip":
        if wide:
            gazetteer, form = F.when(value.rlike(GLOBAL_V6), 1).otherwise(-1), _vote(F.length(value) >= 15, F.length(value) < 9)
        else:
            gazetteer, form = F.when(value.rlike(RESERVED), -1).otherwise(F.lit(1)), _vote(F.length(value) >= 9, F.length(value) < 8)
    elif kind == "card":
        if wide:
            check = F.when(F.length(digits).between(12, 19) & luhn(digits), 1).otherwise(-1)
        gazetteer = F.when(digits.rlike(CARD_ISSUERS), 1).otherwise(-1)
        form = _vote(F.length(digits).isin(15, 16), F.length(digits) < 14)
    elif kind == "phone":
        if wide:
            gazetteer = _vote(value.rlike(COUNTRY_CODES), value.rlike("^00"))
        else:
            gazetteer = F.when(value.rlike(COUNTRY_CODES), 1).otherwise(-1)
        form = _vote(F.length(digits).between(9, 13), F.length(digits) > 15)
    else:
        held = F.regexp_replace(value, r"""^[^=:]{0,20}[=:] {0,3}["']?|["']$""", "")
        check = _vote(held.rlike("[0-9]") & held.rlike("[A-Za-z]"), held.rlike("^[A-Za-z]+$"))
        gazetteer = _vote(value.rlike(KEY_PREFIXES), held.rlike(STAND_INS))
        form = _vote(held.rlike("^[A-Za-z0-9+/_=-]{12,}$"), F.length(held) < 10)
    before = _vote(s["before"].rlike(FOR[kind]), s["before"].rlike(AGAINST))
    edges = _vote(~s["before"].rlike(r"[\p{L}\p{N}]$") & ~s["after"].rlike(r"^[\p{L}\p{N}]"), s["before"].rlike(r"[\p{L}\p{N}]$"))
    return [check, gazetteer, before, edges, form]


SHAPES = (r"^[0-9]+$", r"^[0-9 ]+$", r"^[0-9-]+$", r"^[0-9.]+$", r"^[0-9/ ]+$", r"^\+?[0-9 ().-]+$", r"[\[({<]", r"[=:]")


def _shape(value: Column) -> Column:
    """The first of SHAPES that the value has, 0 for none."""
    out = F.lit(0)
    for i in range(len(SHAPES), 0, -1):
        out = F.when(value.rlike(SHAPES[i - 1]), i).otherwise(out)
    return out.cast("int")


def _near(kind: str, before: Column) -> Column:
    """Which group of words stands before: 1 and 2 of WORDS, 3 those against, 0 none."""
    first, second = (rf"(?i)(?:{w})\W{{0,3}}$" for w in WORDS[kind])
    return F.when(before.rlike(AGAINST), 3).when(before.rlike(first), 1).when(before.rlike(second), 2).otherwise(0).cast("int")


CANDIDATE = "array<struct<start:int,order:int,end:int,kind:string,base:boolean,wide:boolean,check:int,gazetteer:int,before:int,edges:int,form:int,size:int,shape:int,near:int>>"
#: Features of the classifier beyond the votes.
OWN = ("size", "shape", "near")


def _judge(order: int, kind: str, wide: bool):
    def judged(s: Column) -> Column:
        base = F.lit(False) if wide else passes(kind, s["value"])
        size = F.least(F.floor(F.char_length(s["value"]) / 8), F.lit(4)).cast("int")
        votes = [v.cast("int").alias(n) for n, v in zip(LABELERS, _votes(kind, wide, s), strict=True)]
        return F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind"), base.alias("base"), F.lit(wide).alias("wide"), *votes, size.alias("size"), _shape(s["value"]).alias("shape"), _near(kind, s["before"]).alias("near"))

    return judged


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: str | None = None) -> DataFrame:
    """doc_id and found: all candidate spans with their votes, by start and kind; ``carry`` names a column to keep."""
    out = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *([carry] if carry else []))
    lists = []
    for order, kind in enumerate(ALL_KINDS):
        for wide, pattern in ((False, BASE.get(kind)), (True, WIDE.get(kind))):
            if pattern is None:
                continue
            name = f"__{kind}_{int(wide)}"
            own = F.col("text").rlike(WIDE_HINT.get(kind, pattern)) if wide else F.contains("text", F.lit(HINT[kind])) if HINT[kind] else F.col("text").rlike(pattern)
            out = located(out, "text", pattern, name, own)
            lists.append(F.transform(name, _judge(order, kind, wide)).cast(CANDIDATE))
    # A wrong check digit or part speaks against a card number or address unless the words before name one.
    found = F.filter(F.array_sort(F.flatten(F.array(*lists))), lambda c: ~c["kind"].isin("card", "ip") | (c["check"] >= 0) | (c["before"] > 0))
    return out.select("doc_id", *(["text", carry] if carry else []), found.alias("found"))


# -- model -------------------------------------------------------------------------------------------


def expectation_maximisation(rows: list[tuple[str, tuple[int, ...], float]], rounds: int = 50) -> tuple[dict, dict]:
    """(posterior by (kind, votes), reliability by (kind, labeler)) from counted vote patterns.

    A labeler that votes is right with one probability for true spans of a kind and another for others; priors
    are by kind. Starts from a majority in which a vote against counts AGAINST_COUNTS times.
    """
    counts: dict[tuple[str, tuple[int, ...]], float] = {}
    for kind, votes, n in rows:
        counts[kind, votes] = counts.get((kind, votes), 0.0) + n
    post = {k: 1 / (1 + math.exp(-sum(v if v > 0 else AGAINST_COUNTS * v for v in k[1]))) for k in counts}
    right: dict[tuple[str, int], list[float]] = {}
    for _ in range(rounds):
        prior: dict[str, list[float]] = {}
        # votes +1 on true spans, all on true ones, -1 on false ones, all on false ones; two pseudo-votes each
        right = {(k, i): [1.6, 2.0, 1.6, 2.0] for k, _ in counts for i in range(len(LABELERS))}
        for (kind, votes), n in counts.items():
            p, own = post[kind, votes], prior.setdefault(kind, [1.0, 2.0])
            own[0] += n * p
            own[1] += n
            for i, v in enumerate(votes):
                if v:
                    r = right[kind, i]
                    r[0] += n * p * (v > 0)
                    r[1] += n * p
                    r[2] += n * (1 - p) * (v < 0)
                    r[3] += n * (1 - p)
        rate = {i: (min(max(r[0] / r[1], 0.02), 0.98), min(max(r[2] / r[3], 0.02), 0.98)) for i, r in right.items()}
        for kind, votes in counts:
            own = prior[kind]
            odds = math.log(own[0] / (own[1] - own[0] + 1e-9))
            for i, v in enumerate(votes):
                t, f = rate[kind, i]
                odds += 0 if not v else math.log(t / (1 - f)) if v > 0 else math.log((1 - t) / f)
            post[kind, votes] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return post, {(k, LABELERS[i]): (r[0] / r[1], r[2] / r[3]) for (k, i), r in right.items()}


def _features(kind: str, wide: bool, votes: tuple[int, ...], own: tuple[int, ...]) -> list[str]:
    """Of each kind its own, so that what speaks for a phone number need not speak for a card."""
    return [f"{kind}:{x}" for x in ("bias", f"wide={wide}", *[f"{n}={v}" for n, v in zip((*LABELERS, *OWN), (*votes, *own), strict=True)])]


def fit_classifier(rows: list[tuple[str, bool, tuple[int, ...], tuple[int, ...], float]], posterior: dict, steps: int = 300) -> dict[str, float]:
    """Logistic regression on soft labels, over counted feature combinations; each kind weighs as much as another."""
    total: dict[str, float] = {}
    for kind, *_, n in rows:
        total[kind] = total.get(kind, 0.0) + n
    weights: dict[str, float] = {}
    data = [(_features(k, w, v, o), posterior[k, v], n / total[k]) for k, w, v, o, n in rows]
    for _ in range(steps):
        gradient: dict[str, float] = {}
        for names, target, share in data:
            score = sum(weights.get(x, 0.0) for x in names)
            error = share * (target - 1 / (1 + math.exp(-max(-30.0, min(30.0, score)))))
            for x in names:
                gradient[x] = gradient.get(x, 0.0) + error
        for x, g in gradient.items():
            weights[x] = weights.get(x, 0.0) + g - 1e-3 * weights.get(x, 0.0)
    return weights


def train(found: DataFrame) -> dict[str, float]:
    """Weights of the span classifier, from the candidates of all documents."""
    c = found.select(F.explode("found").alias("c")).select("c.*")
    keys = ("kind", "wide", *LABELERS, *OWN)
    rows = [
        (r["kind"], r["wide"], tuple(r[n] for n in LABELERS), tuple(r[n] for n in OWN), float(r["n"]))
        for r in c.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(*keys).collect()
    ]
    posterior, _ = expectation_maximisation([(k, v, n) for k, _, v, _, n in rows])
    return fit_classifier(rows, posterior)


def _accepted(c: Column, weights: dict[str, float]) -> Column:
    """Whether the classifier takes the candidate; kinds that were never seen are not taken."""
    table = F.create_map(*[F.lit(x) for k, w in weights.items() for x in (k, w)]) if weights else F.lit(None).cast("map<string,double>")
    names = ["bias", F.concat(F.lit("wide="), F.initcap(c["wide"].cast("string")))]
    names += [F.concat(F.lit(f"{n}="), c[n].cast("string")) for n in (*LABELERS, *OWN)]
    score = sum((F.coalesce(F.element_at(table, F.concat(c["kind"], F.lit(":"), n if isinstance(n, Column) else F.lit(n))), F.lit(0.0)) for n in names), F.lit(0.0))
    return score > 0


def spans(found: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Add base (the base spans) and spans (with the added ones), each of (start, order, end, kind)."""
    out = found.withColumn("base", F.filter("found", lambda c: c["base"]))
    added = F.filter("found", lambda c: ~c["base"] & _accepted(c, weights) & ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    short = lambda a: F.transform(a, lambda c: F.struct(c["start"], c["order"], c["end"], c["kind"]))
    out = out.withColumn("added", F.when(F.size("found") > F.size("base"), added).otherwise(F.array().cast(CANDIDATE)))
    return out.withColumn("spans", F.array_sort(F.concat(short(F.col("base")), short(F.col("added"))))).withColumn("base", short(F.col("base"))).drop("added")


def named(spans_col: Column) -> Column:
    return F.array_join(F.transform(spans_col, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base, spans: candidates are stored once, the model is trained on them, then applied."""
    found = stored(candidates(docs, id_col, text_col), "candidates")
    return spans(found, train(found)).select("doc_id", "base", "spans")


def digests(found: DataFrame) -> DataFrame:
    """The digest columns; spans are the base ones and all that the method adds, credentials (secret) among them."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    secrets = F.size(F.filter("spans", lambda s: s["kind"] == "secret"))
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(named(F.col("base")).cast("binary"), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"), secrets.cast("long").alias("n_secret"))


def redacted(text: Column, found: Column) -> Column:
    """The text with every span replaced by [KIND]; of spans that overlap, the first one names both."""
    empty = F.array().cast("array<struct<start:int,end:int,kind:string>>")

    def merge(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        own = F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
        touches = (F.size(done) > 0) & (F.get(done, F.size(done) - 1)["end"] > s["start"])
        return F.when(touches, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(done, F.array(own)))

    merged = F.aggregate(found, empty, merge)
    ends = F.concat(F.array(F.lit(0)), F.transform(merged, lambda s: s["end"]))
    pieces = F.transform(merged, lambda s, i: F.concat(F.substring(text, F.get(ends, i) + 1, s["start"] - F.get(ends, i)), F.lit("["), F.upper(s["kind"]), F.lit("]")))
    return F.when(F.size(found) == 0, text).otherwise(F.concat(F.array_join(pieces, ""), F.substring(text, F.element_at(ends, -1) + 1, F.char_length(text))))
