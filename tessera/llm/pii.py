"""Operator 4, PII [native]: keyed surrogates of a kind with what they replace, and checks that none collide.

All in built-in expressions. Entities are found by one pattern. An entity's canonical form (digits
of a number, lower case of an address) and a secret key give a digest, and the digest gives the
surrogate's characters: digits for digits, letters of the same script for letters, the mention's own punctuation
and case around them; names follow the title's gender. So a value has one surrogate wherever and in whichever format
it occurs, with no table of values to join. A check over all distinct values finds surrogates that
two values share or that are values themselves; such values draw again, and only they, usually none,
are joined back to the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored

#: Parts of the pattern; each starts where no word or number is under way, so a long word is tried once.
_FREE, _END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
_FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Mlle", "Sra", "Señora", "Госпожа", "Κυρία")
_MALE = ("Mr", "Herr", "Monsieur", "Sr", "Señor", "Господин", "Κύριος")
_NEUTRAL = ("Dr", "Prof")
_TITLE = "|".join(sorted(_FEMALE + _MALE + _NEUTRAL, key=len, reverse=True))
#: A key and what separates it from its value: a keyword, also behind or before other words of a name, in quotes or not.
_WORD = r"""(?i:(?:[\p{L}\p{N}]+_)*?(?:password|passwd|secret|api[_-]?key|token)(?:[_-][\p{L}\p{N}_-]*+)?)["']?\s{0,3}[=:]\s{0,3}["']?"""
#: Keys that show by their own form: access key ids, and tokens of three encoded parts.
_TOKEN = r"(?:A[KS]IA[A-Z0-9]{16}" + _END + r"|eyJ[\p{L}\p{N}_-]{6,}+\.[\p{L}\p{N}_-]{6,}+\.[\p{L}\p{N}_-]{6,}+)"
KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++",
    "ip": r"(?<![\p{N}.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?!\p{N}|\.\p{N})",
    "ipv6": r"(?<![\p{L}\p{N}:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\p{L}\p{N}:])",
    "iban": _FREE + r"(?:[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?|[a-z]{2}[0-9]{2}(?: ?[0-9]{4}){2,7}(?: ?[0-9]{1,3})?)" + _END,
    "phone": r"(?<![\p{L}\p{N}_+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}" + _END + r"|(?<![\p{L}\p{N}_])\+[0-9]{8,14}" + _END,
    "ssn": _FREE + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _END,
    "card": _FREE + r"(?:[0-9]{13,19}|(?:[0-9]{4}[ -]){3}[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})" + _END,
    "hex": _FREE + r"(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)" + _END,
    "secret": _FREE + _WORD + r"""[\p{L}\p{N}_./+-]{6,}+""" + "|" + _FREE + _TOKEN + r"|(?<=PRIVATE KEY-----)[A-Za-z0-9+/=\s]{40,}+",
    "name": _FREE + rf"(?:{_TITLE})\.? \p{{Lu}}[\p{{L}}'-]++(?: \p{{Lu}}[\p{{L}}'-]++)?",
}
#: The order decides where two kinds fit at one place.
ORDER = ("email", "ip", "ipv6", "hex", "secret", "ssn", "card", "iban", "phone", "name")
PATTERN = "|".join(KINDS[k] for k in ORDER)
_LATIN, _ACCENTED = "abcdefghijklmnopqrstuvwxyz", "àáâäçèéêëíîïñóôöùúûü"
_GREEK, _CYRILLIC = "αβγδεζηθικλμνξοπρστυφχψω", "абвгдежзийклмнопрстуфхцчшщыэюя"
#: Given names by script and gender.
GIVEN = {
    ("latin", "f"): ("Alice", "Bea", "Clara", "Dora", "Elena", "Flora", "Greta", "Hanna", "Ines", "Julia", "Karin", "Lena", "Marta", "Nora", "Olga", "Petra"),
    ("latin", "m"): ("Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Martin", "Niels", "Oskar", "Paul"),
    ("latin", "n"): ("Alex", "Chris", "Dana", "Eli", "Jamie", "Jordan", "Kim", "Lee", "Lou", "Morgan", "Noel", "Robin", "Sam", "Sasha", "Sky", "Toni"),
    ("cyrillic", "f"): ("Анна", "Вера", "Дарья", "Елена", "Зоя", "Ирина", "Мария", "Ольга"),
    ("cyrillic", "m"): ("Антон", "Борис", "Виктор", "Глеб", "Иван", "Максим", "Олег", "Павел"),
    ("greek", "f"): ("Άννα", "Ελένη", "Ειρήνη", "Κατερίνα", "Μαρία", "Σοφία", "Χριστίνα", "Ζωή"),
    ("greek", "m"): ("Ανδρέας", "Γιώργος", "Δημήτρης", "Κώστας", "Μάριος", "Νίκος", "Παύλος", "Πέτρος"),
}


def _pick(letters: str, n: Column) -> Column:
    return F.substr(F.lit(letters), n % len(letters) + 1, F.lit(1))


def kind_of(mention: Column) -> Column:
    """The kind whose pattern the whole mention fits, the first in order."""
    out = None
    for k in ORDER:
        fits = mention.rlike(f"^(?:{KINDS[k]})$")
        out = F.when(fits, k) if out is None else out.when(fits, k)
    return out


_KEYED = "^" + _WORD
_TITLED = rf"^(?:{_TITLE})\.? "


def canonical(kind: Column, mention: Column) -> Column:
    """What mentions of one value have in common: digits of numbers, lower case of the rest; names with their title's gender."""
    gender = F.when(mention.rlike(rf"^(?:{'|'.join(_FEMALE)})\b"), "f").when(mention.rlike(rf"^(?:{'|'.join(_MALE)})\b"), "m").otherwise("n")
    return (
        F.when(kind.isin("phone", "card", "ssn"), F.regexp_replace(mention, "[^0-9+]", ""))
        .when(kind == "iban", F.upper(F.regexp_replace(mention, " ", "")))
        .when(kind == "secret", F.regexp_replace(mention, _KEYED, ""))
        .when(kind == "name", F.concat(gender, F.lit(" "), F.lower(F.regexp_replace(mention, _TITLED, ""))))
        .otherwise(F.lower(mention))
    )


def digest_of(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), kind, value, attempt.cast("string")), 512)


def family_of(value: Column) -> Column:
    """The family name of a name's canonical value: a value of its own kind, "family"."""
    return F.substring_index(value, " ", -1)


def domain_of(value: Column) -> Column:
    """The domain of an e-mail address: a value of its own kind, "domain"."""
    return F.substring_index(value, "@", -1)


def domain_digest(key: str, kind: Column, value: Column) -> Column:
    """What draws an address's domain, so that addresses of one domain stay in one; null for other kinds."""
    return F.when(kind == "email", digest_of(key, F.lit("domain"), domain_of(value), F.lit(0)))


_chars = lambda text: F.filter(F.split(text, ""), lambda c: c != "")


def luhn_digit(body: Column) -> Column:
    """The digit that makes `body` with it behind pass the check of card numbers."""
    value = lambda c, i: F.when(i % 2 == 1, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int"))
    total = F.aggregate(F.transform(_chars(F.reverse(body)), value), F.lit(0), lambda a, x: a + x)
    return ((10 - total % 10) % 10).cast("string")


def mod97(text: Column) -> Column:
    """An account number's digits and letters (10 to 35) as one number, modulo 97."""
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.try_cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(_chars(text), F.lit(0), step)


def checked(kind: Column, value: Column, made: Column) -> Column:
    """A number's surrogate with check digits of its own, where the number's are right: card numbers and accounts."""
    body = F.substr(made, F.lit(1), F.length(made) - 1)
    card = F.when(F.call_function("luhn_check", value), F.concat(body, luhn_digit(body))).otherwise(made)
    turned = lambda x: F.concat(F.substr(x, F.lit(5)), F.substr(x, F.lit(1), F.lit(4)))
    country, account = F.substr(made, F.lit(1), F.lit(2)), F.substr(made, F.lit(5))
    digits = F.lpad((98 - mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0")
    iban = F.when(mod97(turned(value)) == 1, F.concat(country, digits, account)).otherwise(made)
    return F.when(kind == "card", card).when(kind == "iban", iban).otherwise(made)


def core(kind: Column, value: Column, attempt: Column, digest: Column, other: Column | None = None) -> Column:
    """The surrogate of a canonical value, in canonical form: one digest, a character for each of its own.

    other: of a name, the surrogate of its family name, drawn by that name alone; of an e-mail address, the digest of
    its domain. Without it the value's own digest draws them.
    """
    number_of = lambda d, i: F.conv(F.substr(d, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")
    number = lambda i: number_of(digest, i)
    digit = lambda i: _pick("0123456789", number(i))

    def like(c: Column, n: Column) -> Column:
        low = (
            F.when(c.rlike("[0-9]"), _pick("0123456789", n)).when(c.rlike("[a-zA-Z]"), _pick(_LATIN, n)).when(c.rlike(r"\p{IsGreek}"), _pick(_GREEK, n))
            .when(c.rlike(r"\p{IsCyrillic}"), _pick(_CYRILLIC, n)).when(c.rlike(r"\p{IsLatin}"), _pick(_ACCENTED, n)).when(c.rlike(r"\p{L}"), _pick(_LATIN, n))
        )
        return F.coalesce(F.when(c != F.lower(c), F.upper(low)), low, c)

    scrambled = lambda text, d=digest: F.array_join(F.transform(_chars(text), lambda c, i: like(c, number_of(d, i))), "")
    wider = F.when(attempt >= 4, F.concat(digit(F.lit(60)), digit(F.lit(61)), digit(F.lit(62)), digit(F.lit(63)))).otherwise("")
    # a domain of as many labels, each like its own, below a top level that is reserved for examples
    host = scrambled(F.regexp_replace(domain_of(value), r"\.[^.]*$", ""), digest if other is None else F.coalesce(other, digest))
    email = F.concat(scrambled(F.substring_index(value, "@", 1)), wider, F.lit("@"), host, F.lit(".example"))
    octet = lambda i: number(F.lit(i)).cast("string")
    ip = F.concat_ws(".", (number(F.lit(0)) % 223 + 1).cast("string"), octet(1), octet(2), octet(3))
    hexed = F.array_join(F.transform(_chars(value), lambda c, i: F.when(c == ":", c).otherwise(_pick("0123456789abcdef", number(i)))), "")
    # a number's sign and first digit, an account's country stay
    kept = F.when(kind == "iban", 2).when(value.startswith("+"), 2).otherwise(1)
    number_like = checked(kind, value, F.concat(F.substr(value, F.lit(1), kept), scrambled(F.substr(value, kept + 1))))
    script = F.when(value.rlike(r"\p{IsCyrillic}"), "cyrillic").when(value.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    given = F.lit(None).cast("string")
    for (s, g), names in GIVEN.items():
        fits = (script == s) & ((F.substr(value, F.lit(1), F.lit(1)) == g) if s == "latin" else (F.when(F.substr(value, F.lit(1), F.lit(1)) == "f", "f").otherwise("m") == g))
        given = F.when(fits, F.element_at(F.array(*map(F.lit, names)), number(F.lit(40)) % len(names) + 1)).otherwise(given)
    # late draws are longer by letters of the name's script
    letters = lambda script: F.concat(*[_pick(script, number(F.lit(i))) for i in (59, 60, 61, 62, 63)])
    longer = F.when(attempt >= 4, F.when(script == "cyrillic", letters(_CYRILLIC)).when(script == "greek", letters(_GREEK)).otherwise(letters(_LATIN))).otherwise("")
    surname = F.initcap(F.concat(scrambled(family_of(value)), longer))
    # the family name's digest is its own, so a person has it with and without a given name
    family = surname if other is None else F.coalesce(other, surname)
    person = F.when(F.size(F.split(value, " ")) > 2, F.concat(given, longer, F.lit(" "), family)).otherwise(family)
    return F.when(kind == "family", surname).when(kind == "email", email).when(kind == "ip", ip).when(kind.isin("hex", "ipv6"), hexed).when(kind == "name", person).when(kind == "secret", scrambled(value)).otherwise(number_like)


def dressed(kind: Column, mention: Column, made: Column) -> Column:
    """A surrogate in a mention's own format: its punctuation, prefix, title and case."""
    digits = F.regexp_replace(made, "[^0-9A-Za-z]", "")
    before = lambda i: F.length(F.regexp_replace(F.substr(mention, F.lit(1), i), "[^0-9A-Za-z]", ""))
    filled = F.array_join(F.transform(_chars(mention), lambda c, i: F.when(c.rlike("[0-9A-Za-z]"), F.substr(digits, before(i) + 1, F.lit(1))).otherwise(c)), "")
    cased = F.when((mention == F.upper(mention)) & (mention != F.lower(mention)), F.upper(made)).otherwise(made)
    return (
        F.when(kind.isin("phone", "card", "ssn"), filled)
        .when(kind == "iban", F.when(mention == F.lower(mention), F.lower(filled)).otherwise(filled))
        .when(kind == "secret", F.concat(F.regexp_extract(mention, _KEYED, 0), made))
        .when(kind == "name", F.concat(F.regexp_extract(mention, _TITLED, 0), made))
        .otherwise(cased)
    )


def worth_a_look(text: Column) -> Column:
    """A cheap test that holds for each text with an entity: a digit, an @, a keyword or a title."""
    out = text.rlike(r"[0-9@]|(?i:passw|secret|api.?key|token)|PRIVATE KEY|eyJ|A[KS]IA")
    for t in _FEMALE + _MALE + _NEUTRAL:
        out = out | text.contains(t)
    return out


def mentions(text: Column) -> Column:
    """All mentions in order; null where there can't be any."""
    return F.when(worth_a_look(text), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))


def _shown(kind: Column, value: Column) -> Column:
    """What two surrogates may not share: digits among all kinds of numbers, the lower case of others within their kind."""
    number = kind.isin("phone", "card", "ssn")
    return F.concat(F.when(number, "number").otherwise(kind), F.lit(" "), F.when(number, F.regexp_replace(value, "[^0-9]", "")).otherwise(F.lower(value)))


def _settled(values: DataFrame, key: str, most: int) -> DataFrame:
    """(kind, value, attempt, made) of values(kind, value, real[, family]), each drawn until no surrogate collides."""
    state = values.withColumn("attempt", F.lit(0))
    kind, value = F.col("kind"), F.col("value")
    other = domain_digest(key, kind, value)
    if "family" in values.columns:
        other = F.coalesce("family", other)
    for _ in range(most):
        drawn = state.withColumn("digest", digest_of(key, kind, value, F.col("attempt")))
        drawn = stored(drawn.withColumn("made", core(kind, value, F.col("attempt"), F.col("digest"), other)).withColumn("shown", _shown(kind, F.col("made"))).drop("digest"), "surrogates")
        # in a group of equal surrogates the value that drew least often stays
        groups = drawn.groupBy("shown").agg(F.min(F.struct("attempt", "kind", "value")).alias("first"), F.count("*").alias("n")).where("n > 1")
        shared = drawn.join(groups, "shown").where("value != first.value OR kind != first.kind").select("kind", "value")
        real = drawn.select("kind", "value", "shown").join(values.select(_shown(kind, F.col("real")).alias("shown")), "shown", "left_semi").select("kind", "value")
        bad = stored(shared.union(real).distinct(), "collisions")
        if not bad.head(1):
            return drawn.select("kind", "value", "attempt", "made")
        state = drawn.join(bad.withColumn("hit", F.lit(1)), ["kind", "value"], "left").select(*[drawn[c] for c in values.columns], (F.col("attempt") + F.coalesce("hit", F.lit(0))).alias("attempt"))
    raise RuntimeError(f"surrogates still collide after {most} draws")


def redraws(values: DataFrame, key: str, most: int = 60) -> DataFrame:
    """(kind, value, attempt) of those values(kind, value) whose first surrogate collides.

    A surrogate collides if it is another value of its kind, the value itself, or the surrogate of a
    value that comes earlier; phones, cards and social security numbers are one kind there, by their digits. Who collides draws again, until none does. Family names are values of
    the kind "family"; they settle first, and names with a given name are then held against the
    names, without the gender that a value begins with. A family name alone has its family's surrogate.
    """
    names = values.where("kind = 'name'").withColumn("real", F.expr("substr(value, 3)"))
    families = names.select(F.lit("family").alias("kind"), family_of(F.col("value")).alias("value")).distinct()
    first = _settled(values.where("kind != 'name'").unionByName(families).withColumn("real", F.col("value")), key, most)
    again = first.where("attempt > 0").select("kind", "value", "attempt")
    full = names.where("real LIKE '% %'")
    if not full.head(1):
        return again
    made = first.where("kind = 'family'").select(F.col("value").alias("_family"), F.col("made").alias("family"))
    full = full.join(made, family_of(F.col("value")) == F.col("_family")).select("kind", "value", "real", "family")
    return again.unionByName(_settled(stored(full, "names"), key, most).where("attempt > 0").select("kind", "value", "attempt"))


def _tries(rows: DataFrame, again: DataFrame) -> DataFrame:
    """(node, tries): by text, the places of values that drew again, and how often."""
    placed = rows.where(worth_a_look(F.col("_text"))).select(F.md5("_text").alias("node"), F.posexplode(mentions(F.col("_text"))).alias("at", "m")).withColumn("kind", kind_of(F.col("m")))
    placed = placed.select("node", "at", "kind", canonical(F.col("kind"), F.col("m")).alias("value"))
    # a name's family has a place of its own, -1 - at
    placed = placed.withColumn("own", F.array(F.struct("at", "kind", "value"), F.struct((-1 - F.col("at")).alias("at"), F.when(F.col("kind") == "name", "family").alias("kind"), family_of(F.col("value")).alias("value"))))
    placed = placed.select("node", F.explode("own").alias("o")).select("node", "o.*").where("kind IS NOT NULL").join(again, ["kind", "value"])
    return stored(placed.groupBy("node").agg(F.map_from_entries(F.collect_set(F.struct("at", "attempt"))).alias("tries")), "retries")


def with_surrogates(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """The rows with surrogates in their text and n_entities, how many mentions were replaced, as the last column.

    Null texts stay null and have no entities, empty ones stay empty; very long texts are read whole, by one pass of the
    pattern; of an empty table there are no rows. A column n_entities of the input is replaced; other columns keep their names
    in a struct meanwhile. Repeated rows, and rows of equal text, get equal texts. The values that drew again are stored and joined by text; their table's size is known to the
    planner, which broadcasts it only below its threshold.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "n_entities"]).alias("_row"), F.col(f"`{text_col}`").alias("_text"))
    found = rows.select("_text", F.explode(mentions(F.col("_text"))).alias("m")).withColumn("kind", kind_of(F.col("m")))
    found = found.select(F.md5("_text").alias("node"), "m", "kind", canonical(F.col("kind"), F.col("m")).alias("value"))
    values = stored(found.select("kind", "value").distinct(), "entities")
    again = stored(redraws(values, key), "redraws")
    tries = _tries(rows, again) if again.head(1) else None  # if no value drew again, no text is searched for one
    seen = rows.withColumn("_found", mentions(F.col("_text")))
    seen = seen.withColumn("tries", F.lit(None).cast("map<int,int>")) if tries is None else seen.join(tries, F.md5("_text") == F.col("node"), "left")

    # a mention's kind, value, digest and surrogate in turn, each from the fields before it: expressions stay small
    tried = lambda at: F.coalesce(F.element_at(F.col("tries"), at), F.lit(0))
    own = F.transform("_found", lambda m, i: F.struct(m.alias("m"), kind_of(m).alias("kind"), tried(i).alias("attempt"), tried(-1 - i).alias("again")))
    own = F.transform(own, lambda x: F.struct(x["m"].alias("m"), x["kind"].alias("kind"), x["attempt"].alias("attempt"), x["again"].alias("again"), canonical(x["kind"], x["m"]).alias("value")))
    family = lambda x: F.when(x["kind"] == "name", digest_of(key, F.lit("family"), family_of(x["value"]), x["again"])).otherwise(domain_digest(key, x["kind"], x["value"]))
    own = F.transform(own, lambda x: F.struct(*[x[c].alias(c) for c in ("m", "kind", "attempt", "again", "value")], digest_of(key, x["kind"], x["value"], x["attempt"]).alias("digest"), family(x).alias("family")))
    surname = lambda x: F.when(x["kind"] == "name", core(F.lit("family"), family_of(x["value"]), x["again"], x["family"])).otherwise(x["family"])
    own = F.transform(own, lambda x: F.struct(*[x[c].alias(c) for c in ("m", "kind", "attempt", "value", "digest")], surname(x).alias("family")))
    own = F.transform(own, lambda x: F.struct(x["m"].alias("m"), x["kind"].alias("kind"), core(x["kind"], x["value"], x["attempt"], x["digest"], x["family"]).alias("made")))
    own = F.transform(own, lambda x: dressed(x["kind"], x["m"], x["made"]))
    text = F.array_join(F.zip_with(F.split("_text", PATTERN, -1), own, lambda gap, made: F.concat(gap, F.coalesce(made, F.lit("")))), "")
    some = F.coalesce(F.size("_found") > 0, F.lit(False))
    out = seen.select("_row", F.when(some, text).otherwise(F.col("_text")).alias("_new"), F.when(some, F.size("_found")).otherwise(0).cast("long").alias("n_entities"))
    columns = [F.col("_new").alias(c) if c == text_col else F.col(f"_row.`{c}`") for c in docs.columns if c != "n_entities"]
    return out.select(*columns, "n_entities")
