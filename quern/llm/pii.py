"""Personal data by weak supervision, in DataFrame operations alone.

Fixed patterns give the base spans, looser ones and gazetteers of given names,
streets and places further candidates. Five labelers (pattern, gazetteer,
context, edges, form) vote on every candidate.
Expectation-maximisation over the counted vote patterns estimates how far
each labeler is to be trusted; the posteriors then train a span classifier,
which may add candidates to the base spans and never removes one of those.
Counts cover all documents; their number is bounded by the votes and features
there can be, so the loop runs over a small table on the driver.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import stage_table

# Fixed values of the result contract, written so that no text makes them rescan: base patterns by kind.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WORD = r"\p{Lu}[\p{Ll}'-]{1,20}"
# Gazetteers, in natural order: given names, places, titles, street words.
GIVEN = (
    "Alexander|Alice|Ana|Andrea|Andreas|Andrew|Anna|Anne|Antonio|Barbara|Benjamin|Carlos|Carmen|Catherine|Charles|Charlotte|Christian|Christine|Claire|Claudia|Daniel|David|Elena|Elizabeth|Emily|Emma"
    "|Eva|Fatima|Fernando|Francisco|Friedrich|George|Hans|Helen|Hélène|Henry|Ingrid|Isabel|Jack|James|Jan|Jean|Jennifer|Jessica|Joachim|Johann|John|Jorge|José|Joseph|Juan|Julia|Julie|Karen|Karl|Katharina"
    "|Kevin|Klaus|Laura|Linda|Lisa|Louis|Lucas|Lucía|Luis|Manuel|Margaret|María|Maria|Marie|Mark|Martin|Mary|Matthew|Maximilian|Michael|Miguel|Mohammed|Nancy|Nicolas|Olivia|Pablo|Patricia|Paul|Pedro"
    "|Peter|Philippe|Pierre|Rafael|Richard|Robert|Rosa|Sabine|Samuel|Sandra|Sara|Sarah|Sofia|Sophie|Stefan|Stephen|Susan|Susanne|Teresa|Thomas|Ursula|Victoria|William|Wolfgang|Yusuf"
)
PLACES = "Amsterdam|Barcelona|Berlin|Boston|Bruxelles|Buenos Aires|Chicago|Dublin|Frankfurt|Genève|Hamburg|Köln|Lima|Lisboa|London|Los Angeles|Lyon|Madrid|Marseille|México|München|New York|Paris|Roma|San Francisco|Seattle|Sevilla|Sydney|Toronto|Valencia|Wien|Zürich"
TITLES = "Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Madame|Monsieur|Mme|Señora|Señor|Sra|Sr|Doña|Don"
STREETS = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Court|Square|Terrace|Way"
STREET_ENDS = "straße|strasse|weg|gasse|allee|platz"
STREET_HEADS = "Calle|Avenida|Plaza|Paseo|Rue|Avenue|Boulevard|Place"
#: Further candidates; their kinds follow the base kinds in the result.
LOOSE = {
    "email_spelled": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}+(?:\x20?[\[(]at[\])]\x20?|\x20at\x20)[A-Za-z0-9-]{2,63}+(?:(?:\x20?[\[(]dot[\])]\x20?|\x20dot\x20)[A-Za-z]{2,24}+)+",
    "phone_local": r"(?<![0-9+.)-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9.-])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "name": rf"(?<![\p{{L}}])(?:(?:{TITLES})\.?\x20(?:{WORD}\x20){{0,2}}{WORD}|(?:{GIVEN})(?:\x20{WORD}){{1,2}})",
    "address": rf"(?<![0-9])[0-9]{{1,5}}\x20(?:{WORD}\x20){{1,3}}(?:{STREETS})(?![\p{{L}}])|(?<![\p{{L}}])(?:{WORD}(?:{STREET_ENDS})|(?:{STREET_HEADS})\x20(?:(?:de|del|la|las|los|du|des)\x20){{0,2}}{WORD})\x20[0-9]{{1,5}}(?![0-9])",
    "birth_date": r"(?<![0-9./-])(?:[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2})(?![0-9./-])",
}
KINDS = (*BASE, *LOOSE)
IP_PARTS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.|$)){4}$"

# Gazetteers and context words of the labelers.
DOMAINS = r"\.(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu|ch|at|it|nl|pt|mx|ar|ca|us)$"
CARD_ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)"
CALLING_CODES = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
CONTEXT = {
    "email": r"mail|contact|kontakt|correo|courriel|write|reply",
    "ip": r"\bip\b|address|host|server|client|login|from",
    "card": r"card|visa|credit|karte|tarjeta|carte|payment|mastercard",
    "phone": r"phone|tel|call|fax|mobil|handy|cell|whatsapp|tél",
    "national_id": r"ssn|social|security|\bid\b",
    "iban": r"iban|account|konto|cuenta|compte|bank",
    "name": r"dear|contact|\bby\b|from|regards|signed|name|call|ask for|born|patient|client|customer|resident|herr|frau|señor",
    "address": r"\bat\b|address|lives?|located|office|home|deliver|ship|wohnt|adresse|anschrift|domicilio|habite|vive",
    "birth_date": r"born|birth|\bdob\b|geboren|geburt|\bnée?\b|naissance|nacid[oa]|nacimiento",
}
AGAINST = r"version|\bv\.?$|release|isbn|order|invoice|page|no\.?\x20?$|nr\.?\x20?$|part|model|build"
FAMILY = {"email_spelled": "email", "phone_local": "phone"}

VOTES = ("v_pattern", "v_gazetteer", "v_context", "v_edges", "v_form")
FEATURES = ("f_length", "f_before", "f_after")
ACCEPT = 0.5
#: Items that a prefix scan takes in one go.
BLOCK = 64


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _before(items: Column, value, combine, zero: Column) -> Column:
    """Per item, all items before it folded: a prefix scan.

    Appending to an array copies it, so items are scanned in blocks of BLOCK,
    each from the fold of the blocks before it; a fold of a million items costs
    as much as its items and its blocks.
    """

    def cut(all_: Column) -> Column:
        last = F.floor((F.size(all_) - 1) / BLOCK).cast("int")
        return F.when(F.size(all_) > 0, F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(all_, k * BLOCK + 1, F.lit(BLOCK)))).otherwise(F.slice(F.array(all_), 1, 0))

    def scan(values: Column, of, first: Column) -> Column:
        start = F.struct(first.alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(values, start, lambda acc, x: F.struct(combine(acc["at"], of(x)).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])

    folds = lambda blocks: F.transform(blocks, lambda b: F.aggregate(b, zero, lambda acc, x: combine(acc, value(x))))
    own = lambda blocks: F.flatten(F.zip_with(blocks, scan(folds(blocks), lambda x: x, zero), lambda b, first: scan(b, value, first)))
    return _let(items, lambda all_: _let(cut(all_), own))


def _matches(text: Column, pattern: str, kind: str) -> Column:
    """Array of (kind, start, end, match, before, after) of leftmost non-overlapping matches, in code points, end exclusive.

    ``text`` holds neither \x01 nor \x02, which mark the matches here.
    """
    plain = lambda p: F.replace(F.coalesce(p, F.lit("")), F.lit("\x02"), F.lit(""))

    def piece(parts: Column, i: Column) -> Column:
        """The i-th match, its length with what follows up to the next, and its surroundings, as far as two matches off."""
        match = F.substring_index(F.get(parts, i), "\x02", 1)
        before = F.concat(F.right(plain(F.get(parts, i - 2)), F.lit(30)), F.right(plain(F.get(parts, i - 1)), F.lit(30)))
        after = F.concat(F.left(F.substring_index(F.get(parts, i), "\x02", -1), F.lit(40)), F.left(plain(F.get(parts, i + 1)), F.lit(40)))
        return F.struct(match.alias("match"), (F.length(F.get(parts, i)) - 1).cast("long").alias("span"), F.right(before, F.lit(30)).alias("before"), F.left(after, F.lit(40)).alias("after"))

    def cut(parts: Column) -> Column:
        places = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: piece(parts, i))

    def placed(found: Column, first: Column) -> Column:
        starts = _before(found, lambda m: m["span"], lambda a, b: a + b, F.lit(0).cast("long"))
        return F.zip_with(found, starts, lambda m, s: F.struct(F.lit(kind).alias("kind"), (first + s).alias("start"), (first + s + F.length(m["match"])).alias("end"), m["match"].alias("match"), m["before"].alias("before"), m["after"].alias("after")))

    return _let(F.split(F.regexp_replace(text, pattern, "\x01$0\x02"), "\x01"), lambda parts: _let(cut(parts), lambda found: placed(found, F.length(F.get(parts, F.lit(0))).cast("long"))))


def _apart(loose: Column, base: Column) -> Column:
    """The items of ``loose`` that overlap none of ``base``: by one scan from either side over both, ordered by start."""
    far, never = F.lit(1 << 60).cast("long"), F.lit(-1).cast("long")
    both = F.array_sort(F.concat(loose, base), lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0))
    kinds = F.array(*[F.lit(k) for k in KINDS])
    order = lambda x: F.array_position(kinds, x["kind"])

    def free(items: Column) -> Column:
        reached = _before(items, lambda c: F.when(c["base"], c["end"]).otherwise(never), F.greatest, never)
        ahead = F.reverse(_before(F.reverse(items), lambda c: F.when(c["base"], c["start"]).otherwise(far), F.least, far))
        seen = F.zip_with(items, F.zip_with(reached, ahead, lambda r, a: F.struct(r.alias("r"), a.alias("a"))), lambda c, n: F.struct(c.alias("c"), n.alias("n")))
        kept = F.filter(seen, lambda x: ~x["c"]["base"] & (x["n"]["r"] <= x["c"]["start"]) & (x["n"]["a"] >= x["c"]["end"]))
        return F.array_sort(F.transform(kept, lambda x: x["c"]), lambda a, b: F.when(order(a) != order(b), (order(a) - order(b)).cast("int")).when(a["start"] < b["start"], -1).otherwise(1))

    return F.when(F.size(base) == 0, loose).otherwise(_let(both, free))


def _valid(m: Column) -> Column:
    """Whether a base match passes its kind's check."""
    digits = F.regexp_replace(m["match"], "[^0-9]", "")
    return (
        F.when(m["kind"] == "ip", m["match"].rlike(IP_PARTS))
        .when(m["kind"] == "card", F.length(digits).between(16, 19) & F.call_function("luhn_check", digits))
        .when(m["kind"] == "phone", F.length(digits).between(8, 15))
        .otherwise(True)
    )


def _vote(m: Column, base: bool) -> Column:
    """The candidate's span, its votes (1 for, -1 against, 0 none) and its features."""
    kind, match = m["kind"], m["match"]
    digits = F.regexp_replace(match, "[^0-9]", "")
    before, after = F.lower(m["before"]), m["after"]
    last, next_ = F.right(m["before"], F.lit(1)), F.left(m["after"], F.lit(1))
    yes_no = lambda c: F.when(c, 1).otherwise(-1)
    # what nearly all candidates pass says something only about those that do not
    no = lambda c: F.when(c, -1).otherwise(0)
    of_kind = {k: CONTEXT[FAMILY.get(k, k)] for k in KINDS}
    context = reduce(lambda c, k: c.when(kind == k, before.rlike(of_kind[k])), KINDS[1:], F.when(kind == KINDS[0], before.rlike(of_kind[KINDS[0]])))
    gazetteer = (
        F.when(kind == "email", yes_no(F.lower(match).rlike(DOMAINS)))
        .when(kind == "email_spelled", yes_no(F.lower(match).rlike(r"(?:com|org|net|edu|de|fr|es|io)$")))
        .when(kind == "ip", yes_no(~match.rlike(r"^(?:0|127|255)\.|\.0$")))
        .when(kind == "card", yes_no(digits.rlike(CARD_ISSUERS)))
        .when(kind == "phone", yes_no(match.rlike(CALLING_CODES)))
        .when(kind == "phone_local", no(digits.rlike(r"^(?:[01]|...[01])")))
        .when(kind == "name", yes_no(match.rlike(rf"(?:^|\x20)(?:{GIVEN})(?:\x20|$)")))
        .when(kind == "address", yes_no(after.rlike(rf"^[,\x20]+(?:[0-9]{{4,5}}\x20)?(?:{PLACES})")))
        .when(kind == "birth_date", yes_no(match.rlike(r"(?:19[2-9]|20[01])[0-9]")))
        .when(kind == "national_id", no(match.rlike(r"^(?:000|666|9)|-00-|-0000$")))
        .otherwise(0)
    )
    dull = digits.rlike(r"^([0-9])\1+$|^0123|^1234")
    form = F.when(F.length(digits) > 0, no(dull)).otherwise(0)
    touching = last.rlike("[A-Za-z0-9_]") | next_.rlike("[A-Za-z0-9_]")
    mark = lambda c: F.when(c == "", "edge").when(c.rlike(r"\s"), "space").when(c.rlike("[A-Za-z0-9_]"), "word").otherwise("mark")
    return F.struct(
        kind.alias("kind"),
        m["start"].alias("start"),
        m["end"].alias("end"),
        F.lit(base).alias("base"),
        F.lit(1 if base else 0).alias("v_pattern"),
        gazetteer.alias("v_gazetteer"),
        F.when(context, 1).when(before.rlike(AGAINST), -1).otherwise(0).alias("v_context"),
        no(touching).alias("v_edges"),
        form.alias("v_form"),
        F.least(F.floor(F.length(match) / 4), F.lit(12)).cast("string").alias("f_length"),
        mark(last).alias("f_before"),
        mark(next_).alias("f_after"),
    )


def candidates(docs: DataFrame) -> DataFrame:
    """(row, found): the columns of ``docs`` but its text, and every candidate with votes and features."""
    others = [F.col(c) for c in docs.columns if c != "text"]
    # tables of one row keep the optimizer from working a column out wherever it is named
    once = lambda value, name: F.inline(F.array(F.struct(value.alias(name))))
    plain = docs.select(F.struct(*others).alias("row"), "text").select("row", once(F.translate(F.coalesce("text", F.lit("")), "\x01\x02", "\x03\x03"), "x"))
    text = F.col("x")
    base = [F.transform(F.filter(_matches(text, p, k), _valid), lambda m: _vote(m, True)) for k, p in BASE.items()]
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,base:boolean,v_pattern:int,v_gazetteer:int,v_context:int,v_edges:int,v_form:int,f_length:string,f_before:string,f_after:string>>")
    # a pattern's fixed marks spare the texts that lack them
    needs = {
        "email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9]", "phone": "\\+[0-9]", "email_spelled": "[ (\\[]at[ )\\]]", "phone_local": "[0-9]", "national_id": "-[0-9]{2}-", "iban": "[A-Z]{2}[0-9]{2}",
        "name": rf"(?<![\p{{L}}])(?:{TITLES}|{GIVEN})[.\x20]", "address": "[0-9]", "birth_date": "[0-9][./-][0-9]{1,2}[./-][0-9]",
    }
    base = [F.when(text.rlike(needs[k]), b).otherwise(none) for k, b in zip(BASE, base)]
    loose = [F.when(text.rlike(needs[k]), F.transform(_matches(text, p, k), lambda m: _vote(m, False))).otherwise(none) for k, p in LOOSE.items()]
    both = plain.select("row", once(F.concat(*base), "base"), "x").select("row", "base", once(F.concat(*loose), "loose"))
    return both.select("row", F.concat("base", F.when(F.size("loose") > 0, _apart(F.col("loose"), F.col("base"))).otherwise(none)).alias("found"))


@dataclass
class Classifier:
    """Log-odds: a constant for each kind, and weights by (vote or feature, value)."""

    prior: dict[str, float]
    weights: dict[str, dict[str, float]]
    reliability: dict[str, float]


def expectation_maximisation(counted: list[dict], rounds: int = 50) -> tuple[list[float], dict[str, float]]:
    """Posteriors of the counted vote patterns, and each labeler's estimated accuracy where it votes.

    Two classes, votes independent given the class; all labelers start as
    right seven times in ten, the context labeler eight, the pattern labeler nine.
    """
    right = {v: {"v_pattern": 0.9, "v_context": 0.8}.get(v, 0.7) for v in VOTES}
    share: dict[str, float] = defaultdict(lambda: 0.5)
    posterior = [0.5] * len(counted)
    for _ in range(rounds):
        for i, row in enumerate(counted):
            odds = math.log(share[row["kind"]] / (1 - share[row["kind"]]))
            for v in VOTES:
                odds += row[v] * math.log(right[v] / (1 - right[v]))
            posterior[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        mass, total = defaultdict(float), defaultdict(float)
        hit, cast = defaultdict(float), defaultdict(float)
        for p, row in zip(posterior, counted):
            mass[row["kind"]] += p * row["n"]
            total[row["kind"]] += row["n"]
            for v in VOTES:
                if row[v]:
                    hit[v] += row["n"] * (p if row[v] > 0 else 1 - p)
                    cast[v] += row["n"]
        # smoothed towards the start, and never below chance: labelers do not turn round
        share = defaultdict(lambda: 0.5, {k: min(0.98, max(0.02, (mass[k] + 1) / (total[k] + 2))) for k in total})
        before, right = right, {v: min(0.98, max(0.51, (hit[v] + 7) / (cast[v] + 10))) for v in VOTES}
        if max(abs(right[v] - before[v]) for v in VOTES) < 1e-6:
            break
    return posterior, right


def train(counted: list[dict]) -> Classifier:
    """The final span classifier: posterior-weighted log-odds of every vote and feature value, over candidates beyond the base spans."""
    posterior, reliability = expectation_maximisation(counted)
    yes, no = defaultdict(float), defaultdict(float)
    kind_yes, kind_no = defaultdict(float), defaultdict(float)
    for p, row in zip(posterior, counted):
        if row["v_pattern"]:
            continue  # base spans are settled; the classifier is for the others
        kind_yes[row["kind"]] += p * row["n"]
        kind_no[row["kind"]] += (1 - p) * row["n"]
        for name in (*VOTES, *FEATURES):
            yes[name, str(row[name])] += p * row["n"]
            no[name, str(row[name])] += (1 - p) * row["n"]
    all_yes, all_no = sum(kind_yes.values()), sum(kind_no.values())
    weights: dict[str, dict[str, float]] = {name: {} for name in (*VOTES, *FEATURES)}
    for name, value in sorted(yes):
        odds = math.log((yes[name, value] + 1) / (all_yes + 3)) - math.log((no[name, value] + 1) / (all_no + 3))
        weights[name][value] = odds if name in VOTES else odds / len(FEATURES)
    prior = {k: math.log((kind_yes[k] + 1) / (kind_no[k] + 1)) for k in sorted(kind_yes)}
    return Classifier(prior, weights, reliability)


def _lookup(table: dict[str, float], key: Column) -> Column:
    if not table:
        return F.lit(0.0)
    entries = F.create_map(*[F.lit(x) for item in table.items() for x in item])
    return F.coalesce(F.try_element_at(entries, key), F.lit(0.0))


def _odds(c: Column, model: Classifier) -> Column:
    terms = [_lookup(model.weights[name], c[name].cast("string")) for name in (*VOTES, *FEATURES)]
    return reduce(lambda a, b: a + b, terms, _lookup(model.prior, c["kind"]))


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` without its text, plus ``spans``: array of (kind, start, end, base, score), base spans first by kind.

    The score is the classifier's probability; candidates beyond the base
    spans are kept from ACCEPT on. Null and empty texts have none; repeated
    rows get equal results; an empty table gives an empty result; other
    columns pass through, but a column named spans, which gives way.
    """
    found = stage_table(candidates(docs), "candidates")
    keys = ("kind", *VOTES, *FEATURES)
    counts = found.select(F.explode("found").alias("c")).groupBy(*[F.col(f"c.{k}").alias(k) for k in keys]).agg(F.count("*").alias("n"))
    model = train([r.asDict() for r in counts.orderBy(*keys).collect()])
    scored = F.transform("found", lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base"), (1 / (1 + F.exp(-_odds(c, model)))).alias("score")))
    own = [F.col("row")[c].alias(c) for c in docs.columns if c not in ("text", "spans")]
    return found.select(*own, F.filter(scored, lambda s: s["base"] | (s["score"] >= ACCEPT)).alias("spans"))
