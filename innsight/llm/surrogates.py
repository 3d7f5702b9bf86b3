"""Personal data replaced by surrogates, in Spark expressions.

Detected entities (e-mail and IPv4 addresses, telephone, card, social
security and bank account numbers, access tokens, names after a title) are
replaced by others of the same type and shape.  A surrogate is drawn from a
keyed hash of the normalised entity: digits become digits, letters letters of
their script and case; an address stays an address, a card number keeps its
Luhn remainder, a given name the gender its title says, and names keep their
script.  The same entity gets the same surrogate in every document
(coreference; a surname alone is the same person's as with a given name).

Collision checks keep different entities different: of entities with one
surrogate the first keeps it, as long as it is no entity of the corpus itself;
the others draw again, until all are settled.  Names get longer with the attempts,
so there are free ones for any number; the other types keep their shape, and if 200
attempts find none free (``FIXED_ATTEMPTS``), that is an error.

Only texts with an entity are shuffled, cut at their entities; others pass through.

Defined results: a NULL or empty text stays as it is; repeated rows and ties
are replaced alike; an empty table gives no rows; all columns of the
input are kept, ``n_chars`` (if there) is counted anew where a text changed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innsight.llm.common import stage

# Java patterns.  Fixed values: the shapes of the entities and the titles.
_TITLES = {
    "m": "Mr|Sir|Herr|Monsieur|Señor|Don|Signor|г-н|Господин",
    "f": "Mrs|Ms|Miss|Madam|Frau|Madame|Mademoiselle|Mme|Mlle|Señora|Señorita|Doña|Signora|г-жа|Госпожа",
    "x": "Dr|Prof",
}
PATTERNS = {
    "email": r"[\p{L}\p{N}_%+\-]+(?:\.[\p{L}\p{N}_%+\-]+)*@[\p{L}\p{N}\-]+(?:\.[\p{L}\p{N}\-]+)+",
    "token": r"(?<![\p{L}\p{N}])(?=[0-9A-Fa-f]*[0-9])(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32}|[0-9A-F]{64}|[0-9A-F]{40}|[0-9A-F]{32})(?![\p{L}\p{N}])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)[ .\-]?)?[0-9]{2,4}(?:[ .\-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4})(?![\p{L}\p{N}])",
    "card": r"(?<![\p{L}\p{N}])(?:[0-9]{4}[ \-]?){3}[0-9]{4}(?![\p{L}\p{N}])",
    "ssn": r"(?<![\p{L}\p{N}\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}\-])",
    "ip": r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![\p{L}\p{N}]|\.[0-9])",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(_TITLES.values())})\.? \p{{Lu}}\p{{Ll}}+(?:[ \-]\p{{Lu}}\p{{Ll}}+)?(?![\p{{L}}\p{{N}}])",
}
#: Every alternative needs one of these; most texts have few of them.
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Attempts of a type whose surrogates have as many characters as the entity.
FIXED_ATTEMPTS = 200
_SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe fi fo ga ge gi go ka ke ki ko la le li lo ma me mi mo na ne ni no pa pe pi po ra re ri ro sa se si so ta te ti to va ve vi vo za ze zi zo ja je ju du".split(),
    "cyrillic": "ба бе би бо да де ди до фа фе фи фо га ге ги го ка ке ки ко ла ле ли ло ма ме ми мо на не ни но па пе пи по ра ре ри ро са се си со та те ти то ва ве ви во за зе зи зо жа же жу ду".split(),
}


def _let(value: Column, use) -> Column:
    return F.transform(F.array(value), use)[0]


def kind_of(match: Column) -> Column:
    """Type of a matched text: the first pattern that it fully matches."""
    tests = [(k, match.rlike(f"^(?:{p})$")) for k, p in PATTERNS.items()]
    return reduce(lambda rest, t: F.when(t[1], t[0]).otherwise(rest), reversed(tests), F.lit("email"))


def _drawn(digest: Column, i: Column) -> Column:
    """0 to 65535, the i-th number (0-based) drawn from a hex digest."""
    return F.conv(F.substring(digest, F.pmod(i * 4, F.length(digest)).cast("int") + 1, F.lit(4)), 16, 10).cast("int")


def _letters(value: Column, digest: Column, digits_only: Column) -> Column:
    """Digits for digits and, unless ``digits_only``, letters for letters of the same script and case."""
    def other(c: Column, i: Column) -> Column:
        r = _drawn(digest, i)

        def of(alphabet: str) -> Column:
            return F.substring(F.lit(alphabet), F.pmod(r, F.lit(len(alphabet))) + 1, F.lit(1))

        letter = (F.when(c.rlike("[a-z]"), of("abcdefghijklmnopqrstuvwxyz")).when(c.rlike("[A-Z]"), of("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
                  .when(c.rlike(r"\p{IsCyrillic}"), F.when(c.rlike(r"\p{Lu}"), of("АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ")).otherwise(of("абвгдежзиклмнопрстуфхцчшэюя")))
                  .when(c.rlike(r"\p{IsGreek}"), F.when(c.rlike(r"\p{Lu}"), of("ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ")).otherwise(of("αβγδεζηθικλμνξοπρστυφχψω")))
                  .when(c.rlike(r"\p{Lu}"), of("ÀÉÈÖÜÑÇ")).when(c.rlike(r"\p{IsLatin}"), of("àéèöüñç")).otherwise(c))
        return F.when(c.rlike("[0-9]"), F.pmod(r, F.lit(10)).cast("string")).when(digits_only, c).otherwise(letter)

    return F.array_join(F.transform(F.split(value, ""), other), "")


def _hex(value: Column, digest: Column) -> Column:
    return F.array_join(F.transform(F.split(value, ""), lambda c, i: F.lower(F.hex(F.pmod(_drawn(digest, i), F.lit(16)).cast("bigint")))), "")


def _luhn(value: Column) -> Column:
    """Sum of the digits with every second one from the right, but the last, doubled; mod 10."""
    digits = F.transform(F.reverse(F.split(F.regexp_replace(value, "[^0-9]", ""), "")), lambda c: F.coalesce(F.try_to_number(c, F.lit("9")).cast("int"), F.lit(0)))
    doubled = F.transform(digits, lambda d, i: F.when(F.pmod(i, F.lit(2)) == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d))
    return F.pmod(F.aggregate(doubled, F.lit(0), lambda a, d: a + d), F.lit(10))


def _card(value: Column, digest: Column) -> Column:
    drawn = _letters(value, digest, F.lit(True))
    body = F.substring(drawn, F.lit(1), F.length(drawn) - 1)
    return _let(body, lambda b: F.concat(b, F.pmod(_luhn(value) - _luhn(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")))


def _name(value: Column, kind: Column, digest: Column, attempt: Column) -> Column:
    """Capitalised syllables, three and one more every second attempt; a given name ends by its gender."""
    def of(script: str, male: str, female: str) -> Column:
        table = F.array(*[F.lit(s) for s in _SYLLABLES[script]])
        each = F.sequence(F.lit(0), F.floor(attempt / 2).cast("int") + 2)
        stem = F.array_join(F.transform(each, lambda i: F.get(table, F.pmod(_drawn(digest, i), F.lit(len(_SYLLABLES[script]))))), "")
        end = F.when(kind == "given_m", male).when(kind == "given_f", female).otherwise("")
        return F.initcap(F.concat(stem, end))

    return F.when(value.rlike(r"\p{IsCyrillic}"), of("cyrillic", "н", "на")).otherwise(of("latin", "n", "na"))


def surrogate(kind: Column, value: Column, key: str, attempt: Column) -> Column:
    """The surrogate that the keyed hash draws for a normalised entity at an attempt."""
    digest = F.concat(*[F.sha2(F.concat_ws("|", F.lit(key), kind, value, attempt.cast("string"), F.lit(str(i))), 256) for i in range(2)])
    octets = F.concat_ws(".", (F.pmod(_drawn(digest, F.lit(0)), F.lit(223)) + 1).cast("string"), *[F.pmod(_drawn(digest, F.lit(i)), F.lit(256)).cast("string") for i in (1, 2, 3)])
    at = F.instr(value, "@")
    # the top-level domain stays, a country code stays
    end = F.regexp_extract(value, r"\.[^.]*$", 0)
    local, host = F.substring_index(value, "@", 1), F.regexp_replace(F.substring_index(value, "@", -1), r"\.[^.]*$", "")
    email = F.concat(_letters(local, digest, F.lit(False)), F.lit("@"), _letters(host, F.reverse(digest), F.lit(False)), end)
    code = F.regexp_extract(value, r"^\+[0-9]{1,3}", 0)
    phone = F.concat(code, _letters(F.substring(value, F.length(code) + 1, F.length(value)), digest, F.lit(True)))
    land = F.substring(value, F.lit(1), F.lit(2))
    return (F.when((kind == "email") & (at > 0), email).when(kind == "token", _hex(value, digest)).when(kind == "ip", octets).when(kind == "card", _card(value, digest))
            .when(kind == "phone", phone).when(kind == "iban", F.concat(land, F.upper(_letters(F.substring(value, F.lit(3), F.length(value)), digest, F.lit(False)))))
            .when(kind.isin("given_m", "given_f", "given_x", "surname"), _name(value, kind, digest, attempt)).otherwise(_letters(value, digest, F.lit(True))))


def parts_of(match: Column) -> Column:
    """array of struct(kind, value, before): what is replaced in a match, normalised, and the text kept before each."""
    kind = kind_of(match)
    value = F.when(kind.isin("email", "token"), F.lower(match)).when(kind == "iban", F.upper(match)).otherwise(match)
    one = F.array(F.struct(kind.alias("kind"), value.alias("value"), F.lit("").alias("before")))
    title = F.regexp_extract(match, rf"^(?:{'|'.join(_TITLES.values())})\.? ", 0)
    rest = F.substring(match, F.length(title) + 1, F.length(match))
    gender = F.when(title.rlike(f"^(?:{_TITLES['m']})"), "m").when(title.rlike(f"^(?:{_TITLES['f']})"), "f").otherwise("x")
    gender = F.when(title.rlike(f"^(?:{_TITLES['f']})[. ]"), "f").otherwise(gender)
    first, last = F.regexp_extract(rest, r"^(\p{L}+)", 1), F.regexp_extract(rest, r"(\p{L}+)$", 1)
    mark = F.regexp_extract(rest, r"([ \-])", 1)
    surname = F.struct(F.lit("surname").alias("kind"), F.initcap(last).alias("value"), F.when(mark != "", mark).otherwise(title).alias("before"))
    given = F.struct(F.concat(F.lit("given_"), gender).alias("kind"), F.initcap(first).alias("value"), title.alias("before"))
    return F.when(kind != "name", one).when(mark != "", F.array(given, surname)).otherwise(F.array(surname))


def settled(entities: DataFrame, key: str) -> DataFrame:
    """(kind, value, surrogate) of distinct entities; surrogates of a kind differ, and none is an entity."""
    pending = entities.withColumn("attempt", F.lit(0))
    done = None
    attempt = 0
    while True:
        drawn = stage(pending.withColumn("surrogate", surrogate(F.col("kind"), F.col("value"), key, F.col("attempt"))), "drawn")
        free = drawn.join(entities.select("kind", F.col("value").alias("surrogate")), ["kind", "surrogate"], "left_anti")
        if done is not None:
            free = free.join(done.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        won = stage(free.groupBy("kind", "surrogate").agg(F.min("value").alias("value")).select("kind", "value", "surrogate"), "won")
        done = won if done is None else done.unionByName(won)
        pending = stage(drawn.join(won.select("kind", "value"), ["kind", "value"], "left_anti").select("kind", "value", (F.col("attempt") + 1).alias("attempt")), "pending")
        attempt += 1
        if pending.isEmpty():
            return done
        if attempt > FIXED_ATTEMPTS and not pending.where(~F.col("kind").isin("given_m", "given_f", "given_x", "surname")).isEmpty():
            raise RuntimeError("surrogates: no free ones are left for some entities")


def replace_entities(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with the entities in ``text`` replaced, and ``n_entities``."""
    columns = [c for c in docs.columns if c != "n_entities"]
    docs = docs.select(*columns)
    found = docs.withColumn("__found", F.coalesce(F.regexp_extract_all("text", F.lit(f"({_ANY})"), F.lit(0)), F.array().cast("array<string>")))
    clean = found.where(F.size("__found") == 0).select(*columns, F.lit(0).cast("bigint").alias("n_entities"))
    # texts with entities, cut: rows of (text kept before, entity); the tail is the last row, without an entity
    marked = found.where(F.size("__found") > 0).withColumn("__kept", F.split("text", _ANY, -1))
    parts = F.flatten(F.transform("__found", lambda m, i: F.transform(parts_of(m), lambda p, j: F.struct(
        p.kind.alias("kind"), p.value.alias("value"), F.when(j == 0, F.concat(F.get(F.col("__kept"), i), p.before)).otherwise(p.before).alias("before"),
        ((m == F.upper(m)) & (m != F.lower(m))).alias("upper"), (j == 0).alias("first")))))
    cut = stage(marked.select(
        F.monotonically_increasing_id().alias("__row"), F.struct(*[F.col(c) for c in columns if c != "text"], F.element_at("__kept", -1).alias("__tail")).alias("__rest"), parts.alias("__parts")), "cut")
    pieces = cut.select("__row", F.posexplode("__parts").alias("pos", "p")).select("__row", "pos", "p.*")
    entities = stage(pieces.select("kind", "value").distinct(), "entities")
    known = settled(entities, key)
    said = F.when(F.col("upper"), F.upper("surrogate")).otherwise(F.col("surrogate"))
    # hot entities: the pieces are the side that is split, the map has one row of each
    drawn = pieces.join(known, ["kind", "value"])
    texts = drawn.groupBy("__row").agg(
        F.array_sort(F.collect_list(F.struct("pos", F.concat("before", said).alias("s")))).alias("s"), F.sum(F.col("first").cast("bigint")).alias("n_entities"))
    joined = texts.join(cut.select("__row", "__rest"), "__row")
    text = F.concat(F.array_join(F.transform("s", lambda x: x.s), ""), F.col("__rest.__tail"))
    out = {c: F.col(f"__rest.`{c}`") for c in columns if c != "text"}
    if "n_chars" in out and docs.schema["n_chars"].dataType.typeName() in ("long", "integer"):
        out["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    changed = joined.select(*[(text if c == "text" else out[c]).alias(c) for c in columns], "n_entities")
    return clean.unionByName(changed)
