"""Surrogates for personal data (operator 8), in DataFrame functions only.

Detected: e-mail addresses, telephone numbers, IPv4 and IPv6 addresses, card and account numbers, social security numbers, IBANs, access keys, passwords and
tokens after their labels, long hexadecimal secrets, street addresses with a house number, and names after a title or a cue such as "my name is". Names without
either, and addresses without a street's word, aren't found: that takes a trained tagger. Each entity gets a keyed surrogate of the same type and format:

- digits of numbers go through a keyed Feistel permutation, so two numbers never share a surrogate; punctuation and country codes stay, and a card's check digit is
  as right or wrong as it was (Luhn);
- letters and digits of the others are replaced class by class (upper, lower, digit; Latin, Cyrillic) from a keyed digest of the entity in lower case; an IBAN gets right check digits;
- names are replaced word by word: given names after the title's gender, in the same script and case, family names by syllables. Either word is keyed by itself alone, so all
  who share a surname share its surrogate, with or without given names.

Equal entities (but for case) get equal surrogates wherever they occur. Where digests could make two entities, or two family or given names, meet, all distinct ones of the table are checked:
of those with one surrogate all but the first get another attempt, until none meet and, given names apart, none is a real one of its kind. Later attempts have more room: a syllable more
in a name from the second on, and a letter more in the others after LETTERS_KEPT attempts, so that the space grows with the entities. Permuted numbers and IPv4 addresses never meet, but as a
permutation covers its whole space, the surrogate of one may be the number of another.

Null texts stay null; texts without entities stay as they are, byte for byte. Repeated rows are replaced alike. Extra columns stay, whatever their names; a column named as the count gives way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from byteloom.llm.common import possible, stored, unused
from byteloom.llm.fingerprints import let

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_TITLES = r"(?:Mr|Mrs|Ms|Miss|Mister|Herr|Frau|Monsieur|Madame|Mme|Mlle|Señor|Señora|Господин|Госпожа)"
_CUES = r"(?:[Mm]y name is|[Nn]ame:|[Cc]ontact:|[Ss]igned by)"
_NAME = r"\p{Lu}\p{Ll}+(?:[-']\p{Lu}\p{Ll}+)?"
_STREET = r"(?:Street|Road|Avenue|Lane|Drive|Boulevard|Square)"
_STRASSE = r"(?:straße|strasse|gasse)"
_H = r"[0-9a-fA-F]{1,4}"
PATTERN = "|".join([
    r"[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}",
    r"(?i:(?<=password[=:])[^\s\"'!&*%#$]{4,})",
    r"(?i:(?<=password[=:] )[0-9a-f]{8,})",
    r"(?i:(?<=token = \")[0-9a-z]{8,}(?=\"))",
    r"(?i:(?<=(?:token|apikey|api_key|secret)[=:])[0-9a-z]{8,})",
    r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    r"(?<![\w.])" + rf"(?:{_OCTET}\.){{3}}{_OCTET}" + r"(?!\w|\.\d)",
    rf"(?<![\w:])(?:(?:{_H}:){{7}}{_H}|(?:{_H}:){{2,6}}(?::{_H}){{1,5}})(?![\w:])",
    r"(?<!\w)\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\w|\.\d)",
    r"(?<!\w)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)",
    r"(?<![\w.-])\d{3}([-.])\d{3}\1\d{4}(?![\w-]|\.\d)",
    r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    r"(?<![\w-])\d{13,19}(?![\w-])",
    r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])",
    r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    r"(?<!\w)(?=[A-Fa-f]*\d)[0-9a-fA-F]{32,64}(?!\w)",
    rf"(?<!\w)\d{{1,5}} (?:{_NAME} ){{1,3}}{_STREET}(?!\w)",
    rf"(?<!\w)\p{{Lu}}\p{{Ll}}+{_STRASSE} \d{{1,4}}(?!\w)",
    rf"(?<=(?<!\p{{L}}){_TITLES}\.? ){_NAME}(?: {_NAME}){{0,2}}",
    rf"(?<=(?<!\p{{L}}){_CUES} ){_NAME}(?: {_NAME}){{1,2}}",
])
#: A text that doesn't match these has no entity, as every alternative of PATTERN holds one of the first or, with a digit or @ in the text, one of the second; they are much
#: the quicker test. Lookaheads only let most places fail at one look.
WORDS_HINT = rf"(?=[pPtTsSaA])(?i:password|token|secret|api_?key)|AKIA|(?=[MHFSГ]){_TITLES}|(?=[MmNnCcSs]){_CUES}"
DIGITS_HINT = rf"@|\d(?:\d\d|\.\d+\.|(?:[ -]?\d){{12}})|\+\d|:{_H}:|[0-9a-fA-F]{{16}}|[A-Z]{{2}}\d{{2}} ?[A-Z0-9]{{4}}|(?=[SRALDB]){_STREET}|(?=[sg]){_STRASSE} \d"
#: Given names by gender and script, and the syllables that family names are made of: fixed values.
GIVEN = {
    ("f", "latin"): ["Anna", "Clara", "Diana", "Elena", "Flora", "Greta", "Helen", "Irene", "Julia", "Karin", "Laura", "Maria", "Nora", "Olga", "Paula", "Rosa"],
    ("m", "latin"): ["Adam", "Bruno", "Carlo", "David", "Erik", "Felix", "Georg", "Henry", "Ivan", "James", "Karl", "Louis", "Martin", "Oscar", "Peter", "Simon"],
    ("f", "cyrillic"): ["Анна", "Вера", "Дарья", "Елена", "Зоя", "Ирина", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Раиса", "Софья", "Таисия", "Ульяна", "Юлия"],
    ("m", "cyrillic"): ["Антон", "Борис", "Вадим", "Глеб", "Денис", "Егор", "Захар", "Иван", "Кирилл", "Лев", "Матвей", "Никита", "Олег", "Павел", "Роман", "Семен"],
}
SYLLABLES = {
    "latin": ["ba", "cor", "del", "fen", "gar", "hol", "jan", "kem", "lin", "mor", "nev", "par", "ros", "sal", "tor", "wen"],
    "cyrillic": ["ба", "вор", "гал", "ден", "жар", "зим", "кор", "лин", "мор", "нев", "пар", "рос", "сал", "тар", "фен", "хол"],
}
#: What is permuted, so that no two meet, whatever the attempt: 2 to 36 digits that are no four numbers (a password can be such, and is lettered).
_ADDRESS = rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"
_NUMBER = r"^(?!\d+\.\d+\.\d+\.\d+$)(?=(?:\D*\d){2})(?!(?:\D*\d){37})[+(\d][\d ().-]*$"
_CARD = r"^\d(?:[ -]?\d){12,18}$"
_IBAN = r"^[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?$"
_SIX = rf"^(?:{_H}:)+(?::?{_H})+$|^(?:{_H}:){{2,6}}(?::{_H}){{1,5}}$"
_HOUSE = rf"^(.*?)({_STREET}|{_STRASSE})(| \d+)$"
#: Attempts that keep the number of letters and digits of what isn't a number or a name.
LETTERS_KEPT = 3
#: Syllables of a family name at first and at most; a given name has none at first.
SHORTEST, LONGEST = 4, 10
_FEMALE = r"(?:Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Señora|Госпожа)\.? $"
_CALLED = rf"(?:{_TITLES}\.?|{_CUES}) $"


def entities(text: Column) -> Column:
    """The entities of a text, in order."""
    hint = text.rlike(WORDS_HINT) | (text.rlike("[0-9@]") & text.rlike(DIGITS_HINT))
    return F.when(hint, F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _gaps(text: Column) -> Column:
    """What stands before, between and after a text's entities."""
    return F.split(text, PATTERN, -1)


def _before(gaps: Column, i: Column) -> Column:
    """The end of a gap, which holds any title or cue."""
    return F.substring(F.get(gaps, i), -24, 24)


def _digest(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), *parts), 512)


def _number(key: str, limit: Column, *parts: Column) -> Column:
    return F.pmod(F.conv(F.substring(_digest(key, *parts), 1, 14), 16, 10).cast("long"), limit)


def _permuted(digits: Column, key: str) -> Column:
    """A keyed permutation of the digit strings of each length of 2 to 36: six rounds of an unbalanced Feistel network on the two halves."""
    size = F.length(digits)
    power = lambda n: F.pow(F.lit(10.0), n).cast("long")
    pad = lambda value, n: F.lpad(value.cast("string"), n, "0")

    def round_(s, k):
        """One half grows by a keyed number of the other, and they change places."""
        mixed = F.pmod(s["l"] + _number(key, power(s["n"]), k, pad(s["r"], s["m"]), (s["n"] + s["m"]).cast("string")), power(s["n"]))
        return F.struct(s["r"].alias("l"), mixed.alias("r"), s["m"].alias("n"), s["n"].alias("m"))

    def halves(left):
        return F.struct(F.substring(digits, F.lit(1), left).cast("long").alias("l"), F.substring(digits, left + 1, size - left).cast("long").alias("r"), left.alias("n"), (size - left).alias("m"))

    numbers = F.expr("array('0', '1', '2', '3', '4', '5')")
    return F.aggregate(numbers, let(F.floor(size / 2).cast("int"), halves), round_, lambda s: F.concat(pad(s["l"], s["n"]), pad(s["r"], s["m"])))


def luhn(body: Column) -> Column:
    """The check digit that goes after these digits."""

    def weighed(c, i):
        d = c.cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when((F.length(body) - i) % 2 == 1, twice).otherwise(d)

    total = F.aggregate(F.transform(F.filter(F.split(body, ""), lambda c: c != ""), weighed), F.lit(0), lambda s, x: s + x)
    return F.pmod(-total, F.lit(10))


def _card(digits: Column, key: str) -> Column:
    """All digits but the last permuted; the last differs from the right check digit by as much as before."""
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    off = F.substring(digits, -1, 1).cast("int") - luhn(body)
    return let(F.struct(_permuted(body, key).alias("made"), off.alias("off")), lambda s: F.concat(s["made"], F.pmod(luhn(s["made"]) + s["off"], F.lit(10)).cast("string")))


def _numbers(entity: Column, key: str) -> Column:
    """Digits permuted, in the same places; a country code after + stays."""
    code = F.regexp_extract(entity, r"^(\+\d{1,3})(?=[ .(-]\D*\d\D*\d)", 1)
    made = lambda d: F.when(entity.rlike(_CARD), _card(d, key)).otherwise(_permuted(d, key))
    return let(F.struct(code.alias("code"), F.substring(entity, F.length(code) + 1, F.length(entity)).alias("rest")), lambda p: let(let(F.regexp_replace(p["rest"], r"\D", ""), made), lambda d: F.concat(
        p["code"],
        F.aggregate(F.split(p["rest"], ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), lambda s, c: F.when(c.rlike(r"^\d$"), F.struct(F.concat(s["out"], F.substring(d, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))), lambda s: s["out"]),
    )))


def _address(entity: Column, key: str) -> Column:
    """IPv4: the 32 bits permuted by a Feistel network of 16-bit halves."""

    def halves(o):
        at = lambda i: F.get(o, F.lit(i)).cast("long")
        return F.struct((at(0) * 256 + at(1)).alias("l"), (at(2) * 256 + at(3)).alias("r"))

    def round_(s, k):
        return F.struct(s["r"].alias("l"), F.pmod(s["l"] + _number(key, F.lit(65536), k, s["r"].cast("string")), F.lit(65536)).alias("r"))

    octets = lambda h: F.concat_ws(".", F.floor(h / 256).cast("string"), F.pmod(h, F.lit(256)).cast("string"))
    return F.aggregate(F.expr("array('ip0', 'ip1', 'ip2', 'ip3')"), let(F.split(entity, r"\."), halves), round_, lambda s: F.concat_ws(".", octets(s["l"]), octets(s["r"])))


def _lettered(part: Column, digest: Column, hexadecimal: Column) -> Column:
    """Each letter and digit replaced by one of its class, after the bytes of a digest; the rest stays. Letters of other scripts become Latin ones. hexadecimal: a to f only."""
    six = F.when(hexadecimal, 6).otherwise(26)
    pick = lambda alphabet, n, size: F.substring(F.lit(alphabet), F.pmod(n, size if isinstance(size, Column) else F.lit(size)) + 1, F.lit(1))
    lower, upper, letters = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзиклмнопрстуфхцчшэюя"

    def one(c, n):
        small = F.when(c.rlike("^[а-я]$"), pick(letters, n, len(letters))).otherwise(pick(lower, n, six))
        large = F.when(c.rlike("^[А-Я]$"), pick(letters.upper(), n, len(letters))).otherwise(pick(upper, n, six))
        return F.when(c.rlike(r"^\p{N}$"), pick("0123456789", n, 10)).when(c.rlike(r"^\p{Lu}$"), large).when(c.rlike(r"^\p{L}$"), small).otherwise(c)

    number = lambda d, i: F.conv(F.substring(d, F.pmod(i, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int") + i
    return let(digest, lambda d: F.array_join(F.transform(F.split(part, ""), lambda c, i: let(number(d, i), lambda n: one(c, n))), ""))


def _listed(values: list[str]) -> Column:
    return F.expr("array(" + ", ".join(f"'{v}'" for v in values) + ")")


def _named(word: Column, gender: Column, key: str, attempt: Column) -> Column:
    """The surrogate of a word of a name: gender "" for a family name, f, m or n (not known) for a given one."""
    given = gender != ""

    def made(n, script):
        pools = F.when(gender == "f", _listed(GIVEN["f", script])).when(gender == "m", _listed(GIVEN["m", script])).otherwise(_listed(GIVEN["f", script] + GIVEN["m", script]))
        # a family name has SHORTEST syllables, and one more an attempt; a given name none at first, then so many after a hyphen
        count = F.least(F.lit(LONGEST), F.when(given, F.when(attempt > 0, attempt + 1).otherwise(0)).otherwise(SHORTEST + F.greatest(F.lit(0), attempt - 1)))
        syllable = lambda k: F.get(_listed(SYLLABLES[script]), F.pmod(F.call_function("shiftright", n, k * 4), F.lit(len(SYLLABLES[script]))).cast("int"))
        joined = F.initcap(F.array_join(F.transform(F.slice(F.expr(f"array({', '.join(map(str, range(LONGEST)))})"), F.lit(1), count), syllable), ""))
        return F.when(given, F.concat(let(pools, lambda p: F.get(p, F.pmod(F.call_function("shiftright", n, F.lit(40)), F.size(p)).cast("int"))), F.when(count > 0, F.concat(F.lit("-"), joined)).otherwise(""))).otherwise(joined)

    drawn = _number(key, F.lit(1 << 55), F.lit("name"), gender, F.lower(word), attempt.cast("string"))
    return let(drawn, lambda n: F.when(word.rlike(r"\p{IsCyrillic}"), made(n, "cyrillic")).otherwise(made(n, "latin")))


def _mod97(text: Column) -> Column:
    """The remainder by 97 of letters and digits, letters counting from 10."""
    value = lambda c: F.ascii(c) - F.when(c.rlike("[0-9]"), 48).otherwise(55)
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c.rlike("[A-Z0-9]")), F.lit(0), lambda s, c: F.pmod(s * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c), F.lit(97)))


def kind(entity: Column, before: Column) -> Column:
    """The type of an entity; before: the text up to it."""
    return (
        F.when(F.instr(entity, "@") > 0, "mail").when(entity.rlike(_ADDRESS), "ip").when(entity.rlike(_NUMBER), "number").when(entity.rlike("^AKIA[0-9A-Z]{16}$"), "access").when(entity.rlike(_IBAN), "iban")
        .when(entity.rlike(_SIX), "ip6").when(entity.rlike(r"^[0-9a-fA-F]+$"), "hex").when(entity.rlike(r"^[^\d@]+$") & before.rlike(_CALLED), "name").when(entity.rlike(_HOUSE), "street").otherwise("other")
    )


def _gender(before: Column) -> Column:
    return F.when(before.rlike(_FEMALE), "f").when(before.rlike(_CUES + " $"), "n").otherwise("m")


def units(entity: Column, before: Column) -> Column:
    """What an entity's surrogate is keyed by and checked for: itself, or the words of a name; each a struct of type and value in lower case."""
    one = lambda k, v: F.struct(k.alias("kind"), F.lower(v).alias("value"))

    def words(ws):
        return F.transform(ws, lambda w, i: one(F.when(i < F.size(ws) - 1, F.concat(F.lit("given "), _gender(before))).otherwise(F.lit("family")), w))

    return let(kind(entity, before), lambda k: F.when(k == "name", let(F.split(entity, " "), words)).otherwise(F.array(one(k, entity))))


def _surrogate(which: Column, entity: Column, key: str, attempt: Column) -> Column:
    """The replacement of an entity of one unit; its lower case is that of the entity in lower case."""
    low = F.lower(entity)
    at = F.instr(entity, "@")
    more = F.greatest(F.lit(0), attempt - LETTERS_KEPT)
    part = lambda i: F.regexp_extract(entity, f"(?i){_HOUSE}", i)
    own = lambda salt: _digest(key, F.lit(salt), low, attempt.cast("string"))

    def pieces(first, a, mid=F.lit(""), b=F.lit(""), last=F.lit(""), second=None):
        """What stays, what is lettered and grows, what stays, what is lettered by a digest, what stays."""
        return F.struct(first.alias("first"), a.alias("a"), mid.alias("mid"), b.alias("b"), last.alias("last"), (second if second is not None else own("b")).alias("second"))

    rest = lambda n: pieces(F.substring(entity, F.lit(1), F.lit(n)), F.substring(entity, F.lit(n + 1), F.length(entity)))
    domain = F.substring(entity, at + 1, F.length(entity))
    stem, end = (F.regexp_extract(domain, r"^(.*)(\.[^.]*)$", i) for i in (1, 2))
    cut = (
        F.when(which == "mail", pieces(F.lit(""), F.substring(entity, F.lit(1), at - 1), F.lit("@"), stem, end, _digest(key, F.lit("domain"), F.lower(stem))))
        .when(which == "access", rest(4)).when(which == "iban", rest(4)).when(which == "street", pieces(F.lit(""), part(1), part(2), part(3))).otherwise(rest(0))
    )
    hexadecimal = which.isin("hex", "ip6")
    made = let(cut, lambda c: F.concat(c["first"], _lettered(F.concat(c["a"], F.repeat(F.when(which.isin("access", "iban"), "A").otherwise("a"), more)), own("a"), hexadecimal), c["mid"], _lettered(c["b"], c["second"], hexadecimal), c["last"]))

    def checked(m):
        bank = F.substring(m, F.lit(5), F.length(m))
        digits = F.lpad((98 - _mod97(F.upper(F.concat(bank, F.substring(m, 1, 2), F.lit("00"))))).cast("string"), 2, "0")
        return F.concat(F.substring(m, 1, 2), digits, bank)

    return F.when(which == "ip", _address(entity, key)).when(which == "number", _numbers(entity, key)).when(which == "iban", let(made, checked)).otherwise(made)


def surrogate(entity: Column, before: Column, key: str, attempt) -> Column:
    """The replacement of an entity. attempt(kind, value) is 0, or more where the check found another with the same surrogate."""

    def words(ws):
        def one(w, g):
            return let(attempt(F.when(g == "", "family").otherwise(F.concat(F.lit("given "), g)), F.lower(w)), lambda n: _named(w, g, key, n))

        return F.array_join(F.transform(ws, lambda w, i: let(F.when(i < F.size(ws) - 1, _gender(before)).otherwise(""), lambda g: one(w, g))), " ")

    return let(kind(entity, before), lambda k: F.when(k == "name", let(F.split(entity, " "), words)).otherwise(let(attempt(k, F.lower(entity)), lambda n: _surrogate(k, entity, key, n))))


def _found(text: Column) -> Column:
    """All units of a text."""

    def of(es):
        return F.when(F.size(es) > 0, let(_gaps(text), lambda gaps: F.flatten(F.transform(es, lambda e, i: units(e, _before(gaps, i)))))).otherwise(F.array().cast("array<struct<kind:string,value:string>>"))

    return let(entities(text), of)


def collisions(docs: DataFrame, key: str, text: str = "text", most: int = 60) -> DataFrame:
    """(kind, value, attempt) of the units that need another attempt: a stored table, empty as a rule. The space grows by the round; an error after `most` of them."""
    found = stored(docs.select(F.explode(_found(F.col(text))).alias("u")).select("u.*").groupBy("kind", "value").agg(F.lit(0).alias("attempt")), "entities")
    fixed = F.col("kind").isin("ip", "number")  # of these, only one address written in two ways can meet, and may
    gender = F.when(F.col("kind") == "family", "").otherwise(F.substring("kind", -1, 1))
    named = (F.col("kind") == "family") | F.col("kind").startswith("given ")
    replacement = F.lower(F.when(named, _named(F.col("value"), gender, key, F.col("attempt"))).otherwise(_surrogate(F.col("kind"), F.col("value"), key, F.col("attempt"))))
    for _ in range(most):
        made = stored(found.select("kind", "value", "attempt", fixed.alias("fixed"), replacement.alias("made")), "made")
        # words of names are told apart within family names and within the given names of a gender; all others among each other
        made = made.withColumn("space", F.when(named, F.col("kind")).otherwise(""))
        real = made.where("not fixed and not startswith(kind, 'given ')").join(made.select(F.col("space").alias("s"), F.col("value").alias("real")), (F.col("made") == F.col("real")) & (F.col("space") == F.col("s")), "left_semi").select("kind", "value")
        shared = made.groupBy("space", "made").agg(F.count("*").alias("n")).where("n > 1").select("space", "made")
        later = made.join(shared, ["space", "made"]).withColumn("place", F.row_number().over(Window.partitionBy("space", "made").orderBy(F.desc("fixed"), "kind", "value"))).where("place > 1 and not fixed").select("kind", "value")
        again = stored(real.unionByName(later).distinct(), "again")
        if again.isEmpty():
            return found.where("attempt > 0")
        found = stored(found.join(again.withColumn("more", F.lit(1)), ["kind", "value"], "left").select("kind", "value", (F.col("attempt") + F.coalesce("more", F.lit(0))).alias("attempt")), "entities")
    raise RuntimeError("surrogates did not settle")


def replaced(text: Column, key: str, attempts: Column | None = None) -> Column:
    """A struct of the text with surrogates and their number. attempts: map of "kind value" to attempt."""
    attempt = lambda k, v: F.lit(0) if attempts is None else F.coalesce(F.element_at(attempts, F.concat_ws(" ", k, v)), F.lit(0))

    def rebuilt(found, gaps):
        each = F.transform(found, lambda e, i: F.concat(surrogate(e, _before(gaps, i), key, attempt), F.get(gaps, i + 1)))
        return F.concat(F.get(gaps, F.lit(0)), F.array_join(each, ""))

    def change(found):
        return F.when(F.size(found) > 0, let(_gaps(text), lambda gaps: rebuilt(found, gaps))).otherwise(text)

    return let(entities(text), lambda found: F.struct(change(found).alias("text"), F.size(found).alias("n")))


def anonymise(docs: DataFrame, key: str, text: str = "text", count: str | None = "n_replaced") -> DataFrame:
    """docs with surrogates in its text column and, if named, a column of their number. key: a secret; without one, ValueError. Only texts with entities that collided
    move between executors (and, by the filter's chance, a few others)."""
    if not key:
        raise ValueError("surrogates need a key")
    others = collisions(docs, key, text)
    done, tag, maps_ = unused(docs, "done"), unused(docs, "tag"), unused(docs, "attempts")
    rows, attempts = docs, None
    if not others.isEmpty():
        tagged = docs.withColumn(tag, F.xxhash64(text))
        mentions = tagged.select(tag, F.explode(F.array_distinct(_found(F.col(text)))).alias("u")).select(tag, "u.*").distinct()
        maps = stored(mentions.join(others, ["kind", "value"]).groupBy(tag).agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws(" ", "kind", "value"), "attempt"))).alias(maps_)), "attempts")
        some, rest = possible(tagged, maps, tag)
        rows = some.join(maps, tag, "left").select(*docs.columns, maps_).unionByName(rest.select(*docs.columns, F.lit(None).cast(maps.schema[maps_].dataType).alias(maps_)))
        attempts = F.col(maps_)
    made = rows.withColumn(done, replaced(F.col(text), key, attempts))
    shown = [F.col(f"{done}.text").alias(c) if c == text else F.col(c) for c in docs.columns if c != count]
    return made.select(*shown, *([F.coalesce(f"{done}.n", F.lit(0)).alias(count)] if count else []))
