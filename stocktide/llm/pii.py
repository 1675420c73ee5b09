"""PII surrogates in DataFrame expressions only: detect, give each entity a keyed replacement, check collisions, put back.

One pattern finds all kinds. An entity has one unit (an e-mail address, a number, a key) or, for a person named with a title,
one unit a name, so `Mr. Smith`, `Dr. Smith's` and `Mr. John Smith` keep their common name: a name that is anybody's family name is
one everywhere, and one met with a title of no gender takes the gender that it has elsewhere. A unit's canonical form drops case and
separators: spellings of one unit get the same replacement in their own format (coreference). The replacement is drawn from
HMAC-SHA-256 of kind, canonical form and an attempt number under the key, which comes from a one-row table and so stands in no
plan: digits for digits, letters of the same case for letters, separators kept, octets for octets, a valid check digit where there
was one, names of the same gender and script, an IBAN's country. Attempts go on for units whose replacement another unit has or which
is itself a unit of the corpus (distinctness); of units that want one replacement the least canonical form gets it. Later
attempts draw longer names, so there are always enough; a number whose form has too few values gets, after ATTEMPTS, a tag with its
whole hash.

Secrets are keys of known forms, values assigned to a token, key, secret or password (quoted: 8 characters and more; bare: 12, with a
digit) and free-standing hex (32 and more) or base64 (40 and more). The assignment stays, hex stays hex.

Documents without a hit pass by; only those with hits are dealt, by the hash of their text, and each text brings its own entities. Units
and entities are made distinct before they are dealt, so a value that a third of the documents hold is one row for each task.

Defined cases: null and empty texts stay as they are; repeated rows are each rewritten; documents without an id are rewritten
like any other; other columns are passed through by replace_in() and not read by surrogates().
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, written

ATTEMPTS = 12

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Titles that tell a person's gender, and those that do not, with the name's script left open. Fixed values.
MALE = ("Mr", "Mister", "Sir", "Lord", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Lady", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Κυρία")
NEUTRAL = ("Mx", "Dr", "Doctor", "Prof", "Professor", "Доктор", "Профессор")
_BLANK = "[ \\t\u00a0]"
_INITIAL = "".join(sorted({t[0] for t in MALE + FEMALE + NEUTRAL}))  # tested first, as most places have none of these letters
_TITLE = rf"(?=[{_INITIAL}])(?:{'|'.join(MALE + FEMALE + NEUTRAL)})(?:\.{_BLANK}{{0,3}}|{_BLANK}{{1,3}})"
#: Capitalised words that begin a sentence or a date and end a name. Fixed values.
_STOPS = "The A An And But Or So If When While After Before Then Than As At By For From In On Of To With He She It They We You I His Her Its Their Our My This That These Those There Here Is Was Are Were Has Had Yesterday Today Tomorrow Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April May June July August September October November December However Please Who What Where Why How".split()
#: A letter run that is replaced; what stands between (hyphens, dots, particles, blanks) is kept.
_REST = r"\p{L}*+(?:['’](?!s(?!\p{L}))\p{L}++)*+"  # a possessive's end is no part of a name
_WORD = rf"(?:\p{{Lu}}|(?<=-)\p{{L}}){_REST}"
_NAME = rf"(?:\p{{Lu}}\.(?:-?\p{{Lu}}\.)*|\p{{Lu}}{_REST}(?:-\p{{L}}{_REST})*)"
_NEXT = rf"(?!(?:{'|'.join(_STOPS)})(?![\p{{L}}.'’-])){_NAME}"
_PARTICLE = r"(?:(?:van|von|der|den|de|del|della|di|da|dos|du|la|le|bin|ibn|al|ter|ten|zu|y|e) ){0,3}(?:d['’])?"
#: What stands before an assigned secret; it is kept. Marks of an assignment, for _has_entity().
_ASSIGN = r"(?i:token|key|secret|passw(?:or)?d|pwd)[\"']?[ \t]{0,3}[=:][ \t]{0,3}[\"']?"
_HEX = r"(?:[0-9a-f]{32,}|[0-9A-F]{32,})"
#: Kind -> pattern of a whole entity, tried in this order.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "secret": r"(?<![A-Za-z0-9_-])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64})(?![A-Za-z0-9])",
    "assigned": rf"{_ASSIGN}(?:(?<=[\"'])[!#-&(-~]{{8,}}|(?<![\"'])(?=[!#-&(-~]*[0-9])[!#-&(-+\--:<-~]{{12,}})",
    "hex": rf"(?<![A-Za-z0-9+/_-])(?=[0-9]*[A-Fa-f])(?=[A-Fa-f]*[0-9]){_HEX}(?![A-Za-z0-9+/_-])",
    "base64": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{40,}={0,2}(?![A-Za-z0-9+/_-])",
    "ip": rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)",
    "card": r"(?<![\w.-])\d{4}(?<c>[ -]?)\d{4}\k<c>\d{4}\k<c>\d{4}(?![\d-])",
    "ssn": r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": r"(?<![\w.+])(?:(?:\+?\d{1,3}[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}|\d{3}(?<p>[.-])\d{3}\k<p>\d{4})(?!\d)",
    "person": rf"(?=[{_INITIAL}])(?<![\p{{L}}]){_TITLE}{_PARTICLE}{_NEXT}(?:{_BLANK}{{1,2}}{_PARTICLE}{_NEXT})*",
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
_FIRST = ("ba be bo ca ce co da de do fa fe ga go ha he ja jo ka ke la le li lo ma me mi mo na ne no pa pe ra re ri ro sa se ta te to va ve wa we za".split(), "ба бо ва ве да де жа за зо ка ко ла ле ли ма ме ми на не но па по ра ре ро са се та те то фа".split(), "βα βε γα γε δα δε ζα θα κα κο λα λε μα με να νε πα πο ρα ρε σα σε τα τε φα χα".split())
#: Syllables, and the ends of male, female and other given names and of family names.
_SCRIPTS = {"Latin": (_FIRST[0], "n", "a", "i", "son"), "Cyrillic": (_FIRST[1], "н", "а", "и", "ин"), "Greek": (_FIRST[2], "ς", "α", "ι", "ης")}


def _keyed(key: str, units: DataFrame) -> DataFrame:
    """units with h: 192 hex digits, HMAC-SHA-256 of kind, canon, attempt and a number under the key."""
    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    pads = [bytearray(b ^ x for b in raw) for x in (0x36, 0x5C)]
    table = units.sparkSession.createDataFrame([tuple(pads)], "_inner binary, _outer binary")  # one row, in no plan's text

    def part(i: int) -> Column:
        said = F.concat_ws("\x1f", "kind", "canon", F.col("attempt").cast("string"), F.lit(str(i))).cast("binary")
        return F.sha2(F.concat("_outer", F.unhex(F.sha2(F.concat("_inner", said), 256))), 256)

    return units.crossJoin(F.broadcast(table)).withColumn("h", F.concat(*map(part, range(3)))).drop("_inner", "_outer")


def _byte(k) -> Column:
    at = F.pmod(k, F.lit(96)) if isinstance(k, Column) else F.lit(k % 96)
    return F.conv(F.substring(F.col("h"), F.lit(1) + F.lit(2) * at, F.lit(2)), 16, 10).cast("int")


def _alike(text: Column, first_digit_from: int = 0) -> Column:
    """Each ASCII letter and digit replaced by another of its class, all else kept."""
    pick = lambda letters, b: F.substring(F.lit(letters), b % len(letters) + 1, F.lit(1))
    lower, upper = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def step(acc: Column, c: Column) -> Column:
        b = _byte(acc["k"])
        digit = F.when((acc["k"] == 0) & F.lit(first_digit_from > 0), (b % (10 - first_digit_from) + first_digit_from).cast("string")).otherwise((b % 10).cast("string"))
        new = F.when(c.rlike("[0-9]"), digit).when(c.rlike("[a-z]"), pick(lower, b)).when(c.rlike("[A-Z]"), pick(upper, b)).otherwise(c)
        return F.struct(F.concat(acc["out"], new).alias("out"), (acc["k"] + c.rlike("[0-9A-Za-z]").cast("int")).alias("k"))

    return F.aggregate(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), F.struct(F.lit("").alias("out"), F.lit(0).alias("k")), step, lambda acc: acc["out"])


def _luhn(digits: Column) -> Column:
    """The check sum of a string of digits, whose last one counts once."""
    each = F.regexp_extract_all(F.reverse(digits), F.lit("[0-9]"), F.lit(0))
    value = F.transform(each, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(value, F.lit(0), lambda a, v: a + v) % 10


def _digits(text) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _card(text: Column) -> Column:
    first, rest = F.substring(text, F.lit(1), F.lit(1)), _alike(F.substring(text, F.lit(2), F.length(text)))
    made = F.concat(first, rest)
    body = F.substring(made, F.lit(1), F.length(made) - 1)
    check = F.pmod(F.lit(10) - _luhn(F.concat(_digits(body), F.lit("0"))), F.lit(10)).cast("string")
    return F.when(_luhn(_digits(text)) == 0, F.concat(body, check)).otherwise(made)


def _iban(text: Column) -> Column:
    """Country and blanks kept; the check digits are made right if they were."""

    def rest(t: Column) -> Column:
        each = F.regexp_extract_all(F.upper(t), F.lit("[0-9A-Z]"), F.lit(0))
        value = F.transform(each, lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55))
        return F.aggregate(value, F.lit(0), lambda a, v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97)

    country, body = F.substring(text, F.lit(1), F.lit(2)), F.substring(text, F.lit(5), F.length(text))
    made = _alike(body)
    check = F.lpad((98 - rest(F.concat(made, country, F.lit("00")))).cast("string"), 2, "0")
    right = rest(F.concat(body, F.substring(text, F.lit(1), F.lit(4)))) == 1
    return F.concat(country, F.when(right, check).otherwise(_alike(F.substring(text, F.lit(3), F.lit(2)))), made)


def _name(script: str) -> Column:
    """Three syllables, one more with every third attempt, and an end for gender or family."""
    syllables, male, female, other, family = _SCRIPTS[script]
    table = F.array(*map(F.lit, syllables))
    places = F.sequence(F.lit(0), F.lit(2) + F.floor(F.col("attempt") / 3).cast("int"))
    stem = F.initcap(F.array_join(F.transform(places, lambda k: F.element_at(table, _byte(k) % len(syllables) + 1)), ""))
    end = F.when(F.col("kind").startswith("given_m"), male).when(F.col("kind").startswith("given_f"), female).when(F.col("kind").startswith("given"), other).otherwise(family)
    return F.concat(stem, end)


def _is_name() -> Column:
    return F.col("kind").rlike("^(?:given|family|initial)_")


def _replacement(unit: Column) -> Column:
    """What unit (a spelling of the row's kind and canon) becomes at the row's attempt; h: _bytes()."""
    kind = F.col("kind")
    prefix = F.regexp_extract(unit, r"^(?:AKIA|gh[pousr]_|sk-)", 0)
    country = F.regexp_extract(unit, r"^(?:\+?\d{1,3}(?=[ .-]?\()|\+\d{1,3}(?=[ .-]))", 0)
    after = lambda p: F.substring(unit, F.length(p) + 1, F.length(unit))
    hexes = F.substring(F.repeat("h", F.ceil(F.length(unit) / 192).cast("int")), F.lit(1), F.length(unit))
    top = F.regexp_extract(unit, r"\.[^.]*$", 0)
    person = F.when(kind.endswith("Cyrillic"), _name("Cyrillic")).when(kind.endswith("Greek"), _name("Greek")).otherwise(_name("Latin"))
    person = F.when((unit == F.upper(unit)) & (F.length(unit) > 2), F.upper(person)).otherwise(person)
    person = F.when(kind.startswith("initial"), F.substring(person, 1, 1)).otherwise(person)
    made = (
        F.when(kind == "email", F.concat(_alike(F.substring(unit, F.lit(1), F.length(unit) - F.length(top))), top))
        .when(kind == "ip", F.concat_ws(".", *((_byte(k) % 254 + 1).cast("string") for k in range(4))))
        .when(kind == "card", _card(unit))
        .when((kind == "secret") & unit.rlike(f"^{_HEX}$"), F.when(unit == F.lower(unit), F.lower(hexes)).otherwise(F.upper(hexes)))
        .when(kind == "secret", F.concat(prefix, _alike(after(prefix))))
        .when(kind == "phone", F.concat(country, _alike(after(country), 2)))
        .when(kind == "iban", _iban(unit))
        .when(kind == "ssn", _alike(unit))
        .otherwise(person)
    )
    return F.when((F.col("attempt") < ATTEMPTS) | _is_name(), made).otherwise(F.concat(F.lit("["), F.upper("kind"), F.lit("-"), F.substring("h", 1, 64), F.lit("]")))


def _canon(kind: Column, unit: Column) -> Column:
    """The spelling-free form of a unit: phones without their country's code, numbers without separators, the rest in lower case."""
    country = r"^(?:\+?\d{1,3}(?=[ .-]?\()|\+\d{1,3}(?=[ .-]))"
    return F.when(kind == "phone", _digits(F.regexp_replace(unit, country, ""))).when(kind.isin("card", "ssn"), _digits(unit)).when(kind.isin("secret"), unit).otherwise(F.lower(F.regexp_replace(unit, " ", "")))


def units_of(entities: DataFrame) -> DataFrame:
    """entity -> place, kind, unit, canon: the parts of an entity that are replaced."""
    kind = F.coalesce(*(F.when(F.col("entity").rlike(f"^(?:{p})$"), F.lit("secret" if k in ("assigned", "hex", "base64") else k)) for k, p in KINDS.items()), F.lit("phone"))
    script = F.when(F.col("entity").rlike(r"\p{IsCyrillic}+$"), "Cyrillic").when(F.col("entity").rlike(r"\p{IsGreek}+$"), "Greek").otherwise("Latin")
    titled = lambda titles: F.col("entity").rlike(rf"^(?:{'|'.join(titles)})(?!\p{{L}})")
    gender = F.when(titled(FEMALE), "f").when(titled(NEUTRAL), "n").otherwise("m")
    e = entities.withColumn("whole", kind).withColumn("gender", gender).withColumn("script", script)
    names = F.regexp_extract_all(F.regexp_replace("entity", f"^{_TITLE}", ""), F.lit(_WORD), F.lit(0))
    last = F.size(F.regexp_extract_all(F.regexp_extract("entity", r"[^ \t\u00a0]+$", 0), F.lit(_WORD), F.lit(0)))  # a hyphenated family name has several
    parts = F.when(F.col("whole") == "person", names).otherwise(F.array(F.regexp_replace("entity", f"^{_ASSIGN}", "")))
    u = e.select("entity", "whole", "gender", "script", (F.size(parts) - last).alias("given"), F.posexplode(parts).alias("place", "unit"))
    of = F.when(F.col("whole") != "person", F.col("whole")).when(F.length("unit") == 1, F.concat(F.lit("initial_"), "script")).when(F.col("place") < F.col("given"), F.concat(F.lit("given_"), "gender", F.lit("_"), "script")).otherwise(F.concat(F.lit("family_"), "script"))
    return _one_kind(u.select("entity", "place", "unit", of.alias("kind")).withColumn("canon", _canon(F.col("kind"), F.col("unit"))))


def _one_kind(units: DataFrame) -> DataFrame:
    """units where a name that is somewhere a family name is one everywhere, and a given name of no gender has the one it has elsewhere."""
    script = F.regexp_extract("kind", "^(?:given_._|family_)(.*)", 1)
    names = units.where(F.col("kind").rlike("^(?:given|family)_")).select("kind", F.col("canon").alias("_canon"), script.alias("_script")).distinct()
    best = names.groupBy("_canon", "_script").agg(F.max(F.col("kind").startswith("family")).alias("_family"), F.min(F.when(~F.col("kind").startswith("given_n"), F.col("kind"))).alias("_known"))
    joined = units.withColumn("_is", script).join(best, (F.col("canon") == F.col("_canon")) & (F.col("_is") == F.col("_script")), "left")
    kind = F.when(F.col("_family"), F.concat(F.lit("family_"), "_script")).when(F.col("kind").startswith("given_n"), F.coalesce("_known", "kind")).otherwise(F.col("kind"))
    return joined.select("entity", "place", "unit", kind.alias("kind"), "canon")


def _resolved(units: DataFrame, key: str) -> DataFrame:
    """kind, canon, attempt: the first attempt of each unit whose replacement is nobody else's and no unit itself."""
    real = written(units.where(~F.col("kind").startswith("initial")).select("kind", "canon").distinct(), "units")
    taken, pending, attempt = None, real, 0
    while True:
        tried = _keyed(key, pending.withColumn("attempt", F.lit(attempt)))
        want = _replacement(F.col("canon"))
        tried = tried.withColumn("want", F.when((F.lit(attempt) < ATTEMPTS) | _is_name(), _canon(F.col("kind"), want)).otherwise(want)).drop("h")
        free = tried.join(real.select("kind", F.col("canon").alias("want")), ["kind", "want"], "left_anti")
        if taken is not None:
            free = free.join(taken.select("kind", "want"), ["kind", "want"], "left_anti")
        won = free.groupBy("kind", "want").agg(F.min("canon").alias("canon")).withColumn("attempt", F.lit(attempt))
        taken = written(won if taken is None else taken.unionByName(won), "taken")
        pending = real.join(taken, ["kind", "canon"], "left_anti")
        if not pending.limit(1).count():
            break
        attempt += 1
    return taken.select("kind", "canon", "attempt")


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """entities: distinct entity strings. Returns entity and surrogate."""
    units = units_of(entities)
    resolved = _resolved(units, key)
    # of initials there are too few for each to have its own
    resolved = resolved.unionByName(units.where(F.col("kind").startswith("initial")).select("kind", "canon", F.lit(0).alias("attempt")).distinct())
    made = _keyed(key, units.join(resolved, ["kind", "canon"])).withColumn("made", _replacement(F.col("unit")))
    title = F.regexp_extract("entity", f"^(?:{_TITLE}|{_ASSIGN})", 0)
    parts = made.groupBy("entity").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "made"))), lambda x: x["made"]).alias("made"))
    between = F.when(F.col("entity").rlike(f"^{_TITLE}"), F.split(F.regexp_replace("entity", f"^{_TITLE}", ""), _WORD, -1)).otherwise(F.array(F.lit(""), F.lit("")))
    rest = F.array_join(F.zip_with(between, "made", lambda b, m: F.concat(b, F.coalesce(m, F.lit("")))), "")
    return parts.select("entity", F.concat(title, rest).alias("surrogate"))


def _has_entity(text: Column) -> Column:
    """Whether PATTERN is found. Every entity has one of a few marks that are found much faster, and most texts have none."""
    mark = text.contains("@") | text.contains("AKIA") | text.contains("sk-") | text.rlike("[0-9]") | text.rlike("gh[pousr]_") | text.rlike(_TITLE) | text.rlike(_ASSIGN)
    return F.coalesce(mark & text.rlike(PATTERN), F.lit(False))


def replace_in(df: DataFrame, key: str, text_col: str = "text", count_col: str | None = None, length_col: str | None = None) -> DataFrame:
    """df with its texts' entities replaced; all columns kept. count_col: also the number of replacements. length_col: a column
    of df that holds the text's length in characters, set anew where the text changes."""
    found = F.regexp_extract_all(F.col(text_col), F.lit(PATTERN), F.lit(0))
    counted = lambda d, n: d.withColumn(count_col, n) if count_col else d
    hit = df.where(_has_entity(F.col(text_col)))
    clean = counted(df.where(~_has_entity(F.col(text_col))), F.lit(0))
    of, own_map = free_name(df, "_text_hash"), free_name(df, "_own")
    pairs = written(hit.select(F.xxhash64(text_col).alias("id"), F.explode(F.array_distinct(found)).alias("entity")), "entities")
    table = surrogates(pairs.select("entity").distinct(), key)
    own = pairs.distinct().join(table, "entity").groupBy(F.col("id").alias(of)).agg(F.map_from_entries(F.collect_list(F.struct("entity", "surrogate"))).alias(own_map))
    joined = hit.join(own, F.xxhash64(text_col) == F.col(of), "left")
    between = F.split(F.col(text_col), PATTERN, -1)
    new = F.array_join(F.zip_with(between, found, lambda p, f: F.concat(p, F.coalesce(F.element_at(own_map, f), f, F.lit("")))), "")
    out = counted(joined, F.size(found)).withColumn(text_col, new).drop(of, own_map)
    if length_col:
        out = out.withColumn(length_col, F.length(text_col).cast(df.schema[length_col].dataType))
    return out.select(*clean.columns).unionByName(clean)
