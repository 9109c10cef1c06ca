"""Surrogates for personal data, in DataFrame expressions only.

Entities are found by one regular expression: e-mail addresses, international and usual national phone numbers,
IPv4 and IPv6 addresses, payment-card numbers, national and bank numbers, access keys and secrets after their label,
and personal names after a form of address or that begin with a listed given name.  16 digits in fours are a card;
other runs of 13 to 19 digits are one where their Luhn check holds.  An entity is made of parts (the words of a name, user and
domain of an e-mail address, else the whole of it), and each part has a keyed surrogate of its own type:

* A string is permuted by a Feistel network over its halves; each round shifts the characters of one half
  within their class by amounts taken from a keyed SHA-256 of the other half.  Classes are digits, hex
  letters of a secret, vowels and consonants by case (Latin, Greek, Cyrillic), the other letters of
  scripts with case by block and case, and the letters of other scripts by block, so length, punctuation, case and
  script stay and no letter of any script stays for want of a class.  The network is a bijection: different strings of a type
  never meet.
* E-mail addresses keep their last label; user and domain are parts, so addresses of one domain still share
  one.  IPv4 octets stay octets: the address is permuted as a 32-bit number, leading zeros stay.  Cards keep
  whether their Luhn check holds and their gaps, phones their country code, access keys their prefix.
* A known given name becomes another of the same gender and script: its list is put in a keyed order and each
  name goes to the next.  Another word of a name is permuted but for its last letter, which often tells the gender.
  Forms of address stay, so "Mrs. Ada Byron", "Ms. Byron" and "Ada Byron" stay one person.

Collision check: the surrogates of all distinct parts are compared with each other and with the parts.  Of parts
of a type with one surrogate the smallest keeps it; the others, and those whose surrogate is itself a part of the corpus,
are made anew with another key until their surrogate is no part and no other's.  (A listed given name is always
replaced by a listed one, which may be the name of another person of the corpus, but no two names get the same.)  From
round ROUNDS on the string is lengthened by its own last character, as all strings of its form may be taken; an IPv4
address then becomes an IPv6 one.  As parts are replaced and not entities, coreference holds for them too.  Up to SENT
exceptions are sent to all tasks; more are joined to the documents that hold them.

The key is a secret of the caller: whoever has it can undo the permutation.  Null text stays null and has no entities; an empty
table stays empty; repeated rows get equal results.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import distinct_name, read, stored

#: The session setting that holds the key of the registered query and of the pipeline.
KEY_SETTING = "spark.tidemark.pii.key"
#: Their key where it is not set: published, so fit for made-up data only.
PUBLISHED_KEY = "tidemark"
ROUNDS = 6
#: So many exceptions at most are sent to all tasks as one map; more are joined to the documents that hold them.
SENT = 1000

# Forms of address and given names by gender, Latin and Cyrillic script.
TITLES = ["Mr.", "Mrs.", "Ms.", "Dr.", "Herr", "Frau", "M.", "Mme", "Mlle", "Sr.", "Sra.", "Srta.", "Don", "Doña", "Г-н", "Г-жа"]
GIVEN = {
    "latin_f": ["Anna", "Maria", "Emma", "Sofia", "Laura", "Julia", "Clara", "Elena", "Marie", "Alice", "Louise", "Carmen", "Lucia", "Sarah", "Emily", "Hannah"],
    "latin_m": ["John", "Peter", "Paul", "Thomas", "Hans", "Karl", "Pierre", "Jean", "Louis", "Carlos", "Juan", "Pedro", "Robert", "William", "David", "Michael"],
    "cyrillic_f": ["Анна", "Мария", "Елена", "Ольга", "Наталья", "Ирина", "Татьяна", "Светлана"],
    "cyrillic_m": ["Иван", "Пётр", "Алексей", "Сергей", "Дмитрий", "Андрей", "Николай", "Михаил"],
}

_NAME = r"\p{Lu}[\p{L}'’-]+"
_LABEL = r"(?i:\b(?:token|secret|api[_-]?key|password)) ?[=:] ?"
#: Kind and pattern, in order of precedence; a match is the whole entity.
KINDS = [
    ("email", r"(?<![\p{L}\p{N}_%+-])[\p{L}\p{N}_%+-]++(?:\.[\p{L}\p{N}_%+-]++)*+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}"),
    ("key", r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b"),
    ("secret", _LABEL + r"(?:\"[^\"\n]+\"|'[^'\n]+'|(?=[^\s\"',;]*\d)[^\s\"',;]{5,}[\p{L}\p{N}/+=_-])"),
    ("iban", r"\b[A-Z]{2}\d{2}(?:(?: ?[A-Z0-9]{4}){3,7}(?:[A-Z0-9]{1,3}| (?=[A-Z]{0,2}\d)[A-Z0-9]{1,3})?|(?: ?[A-Z0-9]{4}){2} ?[A-Z0-9]{3})\b"),
    ("phone", r"\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)"),
    ("card", r"(?<!\d)(?<!\d\.)\d{4}(?:[ -]?\d{4}){3}(?!\d|[ -]\d{3}(?!\d))"),
    ("digits", r"(?<!\d)(?<!\d\.)(?:\d{13,19}|\d{4}[ -]\d{6}[ -]\d{4,5}|\d{4}(?:[ -]\d{4}){3}[ -]\d{3})(?!\d)"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("ip6", r"(?=[0-9A-Fa-f]{0,4}:)(?<![\p{L}\p{N}:.])(?=(?:[0-9A-Fa-f]*:){3})(?=[A-Fa-f:]*\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|(?:[0-9A-Fa-f]{1,4}:){1,7}:)(?![\p{L}\p{N}:])"),
    ("ip", r"(?<!\d)(?<!\d\.)(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)"),
    ("phone", r"(?<![\d.,-])(?:\(\d{3}\) ?\d{3}[ .-]\d{4}|\(0\d{1,4}\) ?\d{2,4}(?:[ .-]?\d{2,4}){1,3}|\d{3}(?:-\d{3}-|\.\d{3}\.| \d{3} )\d{4}|0\d(?:[ .-]\d{2}){4}|0\d{2,4}[ /]\d{3,4}(?:[ -]?\d{2,4}){1,2})(?!\d)"),
    ("name", r"(?=\p{Lu})(?<!\p{L})(?:(?:" + "|".join(t.replace(".", r"\.") for t in TITLES) + r") " + _NAME + r"|(?:" + "|".join(n for g in GIVEN.values() for n in g) + r") " + _NAME + r")(?: " + _NAME + r")*"),
]
#: Label and quote, value, quote.
_SECRET = rf"(?s)^({_LABEL}[\"']?)(.*?)([\"']?)$"
PATTERN = "|".join(f"(?:{p})" for _, p in KINDS)

# Classes of characters; a shift stays in its class.
_NAMED = [
    "0123456789",
    "aeiouy", "bcdfghjklmnpqrstvwxz", "AEIOUY", "BCDFGHJKLMNPQRSTVWXZ",
    "àáâãäåèéêëìíîïòóôõöùúûü", "ÀÁÂÃÄÅÈÉÊËÌÍÎÏÒÓÔÕÖÙÚÛÜ", "çñßš", "ÇÑŠ",
    "αεηιουω", "βγδζθκλμνξπρστφχψ", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ",
    "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "АЕЁИОУЫЭЮЯ", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩ",
]
#: Blocks of the scripts with case: Latin, Greek, Cyrillic, Armenian.
_CASED = [(0xC0, 0x250), (0x370, 0x400), (0x400, 0x530), (0x531, 0x588)]


def _others(low: int, high: int, upper: bool) -> str:
    """The other letters of a block by case."""
    known = set("".join(_NAMED))
    return "".join(c for c in map(chr, range(low, high)) if c.isalpha() and c not in known and c.isupper() == upper)


CLASSES = _NAMED + [_others(a, b, upper) for a, b in _CASED for upper in (False, True)]
#: Secrets are often hex: their letters up to f stay so.
HEX_CLASSES = ["0123456789", "abcdef", "ABCDEF", "ghijklmnopqrstuvwxyz", "GHIJKLMNOPQRSTUVWXYZ"]
#: Letters and digits of scripts without case, first and last: Hebrew, Arabic, Devanagari, Thai, Hiragana, Katakana, Han, Hangul.
RANGES = [(0x5D0, 0x5EA), (0x621, 0x63A), (0x641, 0x64A), (0x660, 0x669), (0x905, 0x939), (0x966, 0x96F), (0xE01, 0xE2E), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3)]
#: Other letters move in blocks of so many code points.
BLOCK = 32


def kind_of(entity: Column) -> Column:
    """The first kind whose pattern is the whole entity; null for digits that are no card."""
    found = reduce(lambda rest, k: F.when(F.regexp_like(entity, F.lit(rf"\A(?:{k[1]})\z")), k[0]).otherwise(rest), reversed(KINDS[:-1]), F.lit("name"))
    card = F.when(_luhn(F.regexp_replace(entity, r"\D", "")) == 0, F.lit("card"))
    return F.element_at(F.transform(F.array(found), lambda k: F.when(k == "digits", card).otherwise(k)), 1)


def _table(classes: list[str]) -> Column:
    """The classes joined, a letter for the class of each character, the classes' starts and sizes."""
    starts = [1 + sum(map(len, classes[:k])) for k in range(len(classes))]
    return F.struct(
        F.lit("".join(classes)).alias("joined"), F.lit("".join(chr(65 + k) * len(x) for k, x in enumerate(classes))).alias("which"),
        F.expr(f"array({', '.join(map(str, starts))})").alias("starts"), F.expr(f"array({', '.join(str(len(x)) for x in classes)})").alias("sizes"))


def _shift(c: Column, by: Column, table: Column) -> Column:
    """The character ``by`` places on in its class.

    The classes stand in one string; a second one of the same length tells each character's class, which keeps
    the expression short whatever the number of classes.  Letters of no class move in their range of code points.
    """
    def moved(at):
        k = F.ascii(F.substring(table["which"], at, F.lit(1))) - 64
        start = F.element_at(table["starts"], k)
        there = F.substring(table["joined"], start + F.pmod(at - start + by, F.element_at(table["sizes"], k)), F.lit(1))
        return F.when(at > 0, there).when(F.rlike(c, F.lit(r"[\p{L}\p{N}]")), _in_range(c, by)).otherwise(c)

    return F.element_at(F.transform(F.array(F.instr(table["joined"], c)), moved), 1)


def _in_range(c: Column, by: Column) -> Column:
    """The character ``by`` places on in its range of code points, or in its block where no range has it."""
    lows, highs = (F.expr(f"array({', '.join(str(r[k]) for r in RANGES)})") for k in (0, 1))

    def moved(code):
        k = F.size(F.filter(lows, lambda x: x <= code))
        inside = (k > 0) & (code <= F.element_at(highs, F.greatest(k, F.lit(1))))
        low = F.when(inside, F.element_at(lows, F.greatest(k, F.lit(1)))).otherwise(code - F.pmod(code, F.lit(BLOCK)))
        size = F.when(inside, F.element_at(highs, F.greatest(k, F.lit(1))) - low + 1).otherwise(BLOCK)
        return F.decode(F.unhex(F.lpad(F.hex((low + F.pmod(code - low + by, size)).cast("long")), 8, "0")), "UTF-32")

    return F.element_at(F.transform(F.array(F.ascii(c)), moved), 1)


def permute(s: Column, key: str | Column, is_hex: Column | None = None) -> Column:
    """Keyed bijection on strings that keeps length and the class of each character; with the classes of hex digits where ``is_hex``."""
    key = F.lit(key) if isinstance(key, str) else key
    table = _table(CLASSES) if is_hex is None else F.when(is_hex, _table(HEX_CLASSES)).otherwise(_table(CLASSES))
    half = F.floor(F.char_length(s) / 2).cast("int")
    state = F.struct(F.substring(s, F.lit(1), half).alias("left"), F.substring(s, half + 1, F.char_length(s)).alias("right"))

    def with_table(table):
        def round_(z, r):
            # The digest is computed once for each half: it rides in the array element beside the character.
            digest = F.array(F.sha2(F.concat_ws("\x1f", key, r.cast("string"), z["right"]), 256))
            each = lambda d: F.transform(F.regexp_extract_all(z["left"], F.lit("(?s)."), F.lit(0)), lambda c, i: _shift(c, F.conv(F.substring(d, F.pmod(i, F.lit(32)) * 2 + 1, F.lit(2)), 16, 10).cast("int"), table))
            return F.struct(z["right"].alias("left"), F.array_join(F.element_at(F.transform(digest, each), 1), "").alias("right"))

        return F.aggregate(F.expr("array(0, 1, 2, 3)"), state, round_, lambda z: F.concat(z["left"], z["right"]))

    return F.element_at(F.transform(F.array(table), with_table), 1)


def _ip(s: Column, key: str) -> Column:
    """Feistel network on the 32-bit number, 16 bits a half; each octet's leading zeros stay."""
    o = F.split(s, r"\.")
    zeros = F.transform(o, lambda x: F.regexp_extract(x, r"^0+(?=\d)", 0))
    part = lambda i: F.element_at(o, i).cast("int")
    state = F.struct((part(1) * 256 + part(2)).alias("a"), (part(3) * 256 + part(4)).alias("b"))
    for r in range(4):
        state = F.element_at(F.transform(F.array(state), lambda z, r=r: F.struct(z["b"].alias("a"), z["a"].bitwiseXOR(F.conv(F.substring(F.sha2(F.concat(F.lit(f"{key}\x1fip{r}\x1f"), z["b"].cast("string")), 256), 1, 4), 16, 10).cast("int")).alias("b"))), 1)
    octets = lambda z: (z["a"] / 256, F.pmod(z["a"], F.lit(256)), z["b"] / 256, F.pmod(z["b"], F.lit(256)))
    return F.element_at(F.transform(F.array(state), lambda z: F.concat_ws(".", *(F.concat(F.element_at(zeros, i + 1), F.floor(x).cast("int").cast("string")) for i, x in enumerate(octets(z))))), 1)


def _luhn(digits: Column) -> Column:
    """Luhn sum modulo 10 of a string of digits."""
    each = F.transform(F.regexp_extract_all(F.reverse(digits), F.lit("."), F.lit(0)), lambda c, i: F.when(F.pmod(i, F.lit(2)) == 1, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int")))
    return F.pmod(F.aggregate(each, F.lit(0), lambda a, x: a + x), F.lit(10))


def _card(s: Column, body: Column) -> Column:
    """The permuted digits and a last one that keeps the Luhn sum, in the gaps of the card."""
    number = F.concat(body, F.pmod(_luhn(F.regexp_replace(s, r"\D", "")) - _luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string"))
    seated = lambda n: F.array_join(F.transform(F.regexp_extract_all(s, F.lit("."), F.lit(0)), lambda c, i: F.when(c.isin(" ", "-"), c).otherwise(F.substring(n, F.char_length(F.regexp_replace(F.substring(s, F.lit(1), i + 1), r"\D", "")), F.lit(1)))), "")
    return F.element_at(F.transform(F.array(number), seated), 1)


def _listed(key: str) -> dict[str, str]:
    """Each given name's surrogate: the next in its list's keyed order."""
    out = {}
    for group, names in GIVEN.items():
        order = sorted(names, key=lambda n: hashlib.sha256(f"{key}\x1f{group}\x1f{n}".encode()).digest())
        out |= dict(zip(order, [*order[1:], order[0]], strict=True))
    return out


def parts(entity: Column, kind: Column) -> Column:
    """array<struct<type, value>>: what an entity is made of; forms of address are no parts."""
    part = lambda t, v: F.struct((F.lit(t) if isinstance(t, str) else t).alias("type"), v.alias("value"))
    words = F.filter(F.split(entity, " "), lambda w: ~F.array_contains(F.array(*map(F.lit, TITLES)), w))
    return (
        F.when(kind == "email", F.array(part("user", F.substring_index(entity, "@", 1)), part("domain", F.substring_index(entity, "@", -1))))
        .when(kind == "name", F.transform(words, lambda w: part("word", w))).otherwise(F.array(part(kind, entity)))
    )


def part_surrogate(kind: Column, value: Column, key: str) -> Column:
    """The keyed surrogate of a part: what stays before and after, and what is permuted between, go by its type."""
    n, whole = F.char_length(value), F.lit(None).cast("string")
    cut = lambda pattern: F.array(*(F.regexp_extract(value, pattern, k) for k in (1, 2, 3)))
    split = (
        F.when(kind == "domain", cut(r"^()(.*)(\.[^.]*)$")).when(kind == "word", F.array(F.lit(""), F.substring(value, F.lit(1), n - 1), F.substring(value, -1, 1)))
        .when(kind == "secret", cut(_SECRET)).when(kind == "phone", cut(r"^(\+\d{1,3}|\(?0|)(.*)()$")).when(kind == "key", cut("^(.{4})(.*)()$")).when(kind == "iban", cut("^(.{2})(.*)()$"))
        .when(kind == "card", F.array(F.lit(""), F.regexp_replace(value, r"\D|\d\D*$", ""), F.lit(""))).otherwise(F.array(F.lit(""), value, F.lit("")))
    )
    names = _listed(key)
    at = F.array_position(F.expr("array(" + ", ".join(f"'{n}'" for n in names) + ")"), value).cast("int")
    named = F.when((kind == "word") & (at > 0), F.element_at(F.expr("array(" + ", ".join(f"'{n}'" for n in names.values()) + ")"), F.greatest(at, F.lit(1)))).otherwise(whole)

    def joined(x):
        body = permute(x[1], F.concat(F.lit(key + "\x1e"), kind), kind.isin("secret", "ip6"))
        return F.element_at(F.transform(F.array(body), lambda b: F.when(kind == "card", _card(value, b)).otherwise(F.concat(x[0], b, x[2]))), 1)

    return F.coalesce(named, F.when(kind == "ip", _ip(value, key)).otherwise(F.element_at(F.transform(F.array(split), joined), 1)))


def surrogate(entity: Column, kind: Column, key: str, special: Column | None = None) -> Column:
    """The keyed surrogate of an entity of the given kind; ``special`` maps "type:value" of parts that have another one."""
    def of(p):
        plain = part_surrogate(p["type"], p["value"], key)
        return plain if special is None else F.coalesce(F.try_element_at(special, F.concat_ws(":", p["type"], p["value"])), plain)

    whole = lambda new: (
        F.when(kind == "email", F.array_join(new, "@"))
        .when(kind == "name", F.concat(F.regexp_extract(entity, _TITLE, 0), F.array_join(new, " "))).otherwise(F.element_at(new, 1)))
    return F.element_at(F.transform(F.array(F.transform(parts(entity, kind), of)), whole), 1)


_TITLE = "^(?:(?:" + "|".join(t.replace(".", r"\.") for t in TITLES) + ") )?"


def _anew(kind: Column, value: Column, key: str, r: int) -> Column:
    """The surrogate of round r: with another key, and of a longer form where all strings of the form may be taken."""
    again = f"{key}\x1e{r}"
    if r < ROUNDS:
        return part_surrogate(kind, value, again)
    longer = F.regexp_replace(value, r"([\p{L}\p{N}])(?=[^\p{L}\p{N}]*$)", "$1" * (r - ROUNDS + 2))
    digest = F.sha2(F.concat(F.lit(again + "\x1f"), value), 256)
    ip = F.concat(F.lit("2001:db8"), *(F.concat(F.lit(":"), F.substring(digest, 1 + 4 * k, 4)) for k in range(6)))
    label = F.regexp_extract(value, r"^(.*?)(\.[^.]*)$", 1)
    domain = F.concat(label, F.substring(label, -1, 1), F.regexp_extract(value, r"^(.*?)(\.[^.]*)$", 2))
    return F.when(kind == "ip", ip).otherwise(part_surrogate(kind, F.when(kind == "domain", domain).otherwise(longer), again))


def _exceptions(known: DataFrame, key: str) -> DataFrame | None:
    """(type, value, surrogate) of the parts that do not keep their plain surrogate; None without any. known: distinct (type, value).

    Each round tries another key for those left.  A try stands if it is no part, no surrogate given before and
    the only one of its round (else the smallest part keeps it).
    """
    known = stored(known)
    first = stored(known.withColumn("surrogate", part_surrogate(F.col("type"), F.col("value"), key)))
    names = known.select("type", F.col("value").alias("surrogate"))
    listed = F.col("value").isin([n for g in GIVEN.values() for n in g]) & (F.col("type") == "word")

    def stands(tried: DataFrame, taken: DataFrame) -> DataFrame:
        """Tries that are not taken, of each surrogate the one of the smallest part."""
        free = tried.join(taken, ["type", "surrogate"], "left_anti")
        return free.groupBy("type", "surrogate").agg(F.min("value").alias("value")).select("type", "value", "surrogate")

    fixed = first.where(listed)
    good = stored(stands(first.where(~listed), names.unionByName(fixed.select("type", "surrogate"))))
    left = stored(first.where(~listed).select("type", "value").join(good, ["type", "value"], "left_anti"))
    if left.isEmpty():
        return None
    given, done, r = [fixed, good], [], 0
    while not left.isEmpty():
        r += 1
        taken = reduce(DataFrame.unionByName, (g.select("type", "surrogate") for g in given), names)
        fresh = stored(stands(left.withColumn("surrogate", _anew(F.col("type"), F.col("value"), key, r)), taken))
        given.append(fresh)
        done.append(fresh)
        left = stored(left.join(fresh, ["type", "value"], "left_anti"))
    return stored(reduce(DataFrame.unionByName, done))


def pseudonymize(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``df`` with its text column replaced, and ``entities``: array<struct<kind, entity, surrogate>> in order."""
    if not key:
        raise ValueError("surrogates need a key")
    added = distinct_name(df.columns, "entities")
    found = F.regexp_extract_all(F.col(text), F.lit(PATTERN), F.lit(0))
    pairs = F.transform(found, lambda e: F.struct(kind_of(e).alias("kind"), e.alias("entity")))
    made = lambda x: F.when(x["kind"].isNotNull(), parts(x["entity"], x["kind"]))
    listed = df.select(F.explode(pairs).alias("x")).where("x.kind is not null").select("x.kind", "x.entity").distinct()
    special = _exceptions(listed.select(F.explode(parts(F.col("entity"), F.col("kind"))).alias("p")).select("p.type", "p.value").distinct(), key)

    def replaced(own: Column | None) -> Column:
        return F.transform(pairs, lambda x: F.struct(x["kind"].alias("kind"), x["entity"].alias("entity"), F.when(x["kind"].isNull(), x["entity"]).otherwise(surrogate(x["entity"], x["kind"], key, own)).alias("surrogate")))

    if special is None:
        plain = df.withColumn(added, replaced(None))
    elif special.count() <= SENT:
        named = [x for r in special.collect() for x in (F.lit(f"{r['type']}:{r['value']}"), F.lit(r["surrogate"]))]  # SENT rows at most
        plain = df.withColumn(added, replaced(F.create_map(*named)))  # a constant of the plan
    else:
        mark = distinct_name([*df.columns, added], "text_key")
        own = distinct_name([*df.columns, added, mark], "special")
        keyed = df.withColumn(mark, F.xxhash64(text))
        used = keyed.select(mark, F.explode(pairs).alias("x")).select(mark, F.explode(made(F.col("x"))).alias("p")).select(F.col(mark), "p.type", "p.value").distinct()
        hits = used.join(special, ["type", "value"]).groupBy(mark).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "type", "value"), "surrogate"))).alias(own))
        plain = keyed.join(hits, mark, "left").withColumn(added, replaced(F.col(own))).drop(mark, own)
    gaps = F.split(F.col(text), PATTERN, -1)
    joined = F.array_join(F.zip_with(gaps, F.transform(F.col(added), lambda x: x["surrogate"]), lambda g, s: F.concat(g, F.coalesce(s, F.lit("")))), "")
    out = plain.withColumn(text, F.when(F.size(added) > 0, joined).otherwise(F.col(text)))
    return out.withColumn(added, F.filter(added, lambda x: x["kind"].isNotNull())).select(*df.columns, added)


def query_key(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, PUBLISHED_KEY)


def op5_surrogates(spark, sf_dir: str) -> DataFrame:
    out = pseudonymize(read(spark, sf_dir, "documents").select("doc_id", "text"), query_key(spark))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.size("entities"), F.lit(0)).cast("long").alias("n_entities"), "entities")


QUERIES = {"op5_surrogates": op5_surrogates}
SQL: dict[str, str] = {}
