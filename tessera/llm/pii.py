"""Surrogates for personal data, with DataFrame functions alone.

Found are e-mail addresses, IPv4 and IPv6 addresses, phone numbers, card numbers, social security numbers, bank account
numbers (IBAN), cloud access keys, passwords before a host, values after words such as password and token, and persons named
after a title, whose names are then replaced in all of the text, with or without it.  Each gets a keyed surrogate of the same type and format: digits stay digits, letters
letters of their case, separators, lengths, country codes and titles stay, octets stay below 256, valid card
numbers stay valid, names get names of their title's gender in their own script (none is known after Dr or Prof).

The same entity gets the same surrogate in all documents and in every way of writing it (case of an
address, separators of a number); a surname has one surrogate with or without a first name, and so has a domain for all its addresses.
Distinct entities of a type get distinct surrogates, none of which is an entity of the corpus: all
entities are checked at once, and those in collision draw again until none is left.  After `WIDE` draws the lengths of
octets and of IPv6 groups go, and local parts, domains and secrets grow, so that short formats can't run out.

Null texts stay null, empty ones empty; texts without a find stay as they are.  Only texts with a find are
shuffled.  Results depend on the text and the key, so repeated rows and null ids need no rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

KEY = "surrogates-1"
#: draws that keep the length of short formats
WIDE = 8

# What is looked for, in this order at each place.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
ASSIGNED = r"(?<![A-Za-z])(?i:password|passwd|pwd|secret|token|api[_-]?key)\s{0,2}[=:]\s{0,2}[\"']?[A-Za-z0-9+/_.-]{6,}"
ACCESS_KEY = r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
IP = r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])"
IP6 = r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])"
CARD = r"(?<![0-9+])(?!00)(?:[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
#: groups of 3, 3 and 4 digits, with or without a country code; other international numbers of 8 to 15 digits after a plus or 00; ten digits in a row
PHONE = (
    r"(?<![0-9A-Za-z.])(?:(?:\+[0-9]{1,3}[ .-]?)?(?:\(?[0-9]{3}\)?[ .-]|\([0-9]{3}\))[0-9]{3}[ .-][0-9]{4}(?![0-9])"
    r"|(?:\+|00)[1-9](?:[ .()/-]{0,2}[0-9]){7,14}(?![0-9])|(?<![-_/#=+])[2-9][0-9]{9}(?![0-9A-Za-z_]|[.-][0-9]))"
)
#: the country code at the head of an international number
COUNTRY = r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
MALE, FEMALE = "Mr|Herr|Señor|Sr|Monsieur|Господин|Κύριος", "Mrs|Ms|Miss|Frau|Señora|Sra|Madame|Mme|Госпожа|Κυρία"
NEUTRAL = "Dr|Prof|Doctor|Professor|Доктор|Профессор"
#: a name, with capitals inside and joined parts; words before a surname; a surname in capitals
NAME = r"\p{Lu}(?:['’]?\p{Lu})?\p{Ll}+(?:\p{Lu}\p{Ll}+)*(?:[-'’]\p{Lu}\p{Ll}+)*"
BEFORE = r"(?:(?:de|del|della|di|da|das|do|dos|du|la|le|van|von|der|den|ter|zu|bin|al|el) ){1,3}"
CAPITALS = r"\p{Lu}{2,}(?:['’-]\p{Lu}{2,})*"
PERSON = rf"(?<!\p{{L}})(?:{MALE}|{FEMALE}|{NEUTRAL})\.? (?:(?:{NAME} )?(?:{BEFORE})?{NAME}|{CAPITALS})(?!\p{{L}})"
#: a user and a password before the host of an address of the web; the form alone is for what has been found
LOGIN_FORM = r"[^\s/:@]{1,64}:[^\s/@]{3,64}"
LOGIN = rf"(?<=://){LOGIN_FORM}(?=@)"
ANY = "|".join((LOGIN, EMAIL, ASSIGNED, ACCESS_KEY, IBAN, IP6, IP, CARD, SSN, PHONE, PERSON))
#: without one of these a text holds nothing that is looked for
HINT = rf"[0-9@]|(?i:pass|pwd|secret|token|api)|{MALE}|{FEMALE}|{NEUTRAL}|::"

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: name syllables and endings by script
SYLLABLES = {
    "latin": ("ba be bo da de di do fa fe ga go ha he jo ka ke ko la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se si so ta te ti to va ve vi".split(), "n", "a", "r"),
    "cyrillic": ("ба бе бо ва ве ви во га го да де до за зе ка ко ла ле ли ло ма ме ми мо на не ни но па по ра ре ри ро са се та те ти то".split(), "н", "я", "р"),
    "greek": ("βα βε βο γα γο δα δε δο ζα θα θε κα κε κο λα λε λι λο μα με μι μο να νε νι νο πα πε πο ρα ρε ρι ρο σα σε τα τε τι το".split(), "ν", "α", "ς"),
}


def _pieces(text: Column) -> Column:
    """A text as literals and entities, in order: array of (lit, kind, norm)."""
    s = lambda lit, kind=None, norm=None: F.struct(lit.alias("lit"), (kind if kind is not None else F.lit(None).cast("string")).alias("kind"), (norm if norm is not None else F.lit(None).cast("string")).alias("norm"))
    digits = lambda m: F.regexp_replace(m, "[^0-9]", "")

    def one(m: Column) -> Column:
        full = lambda r: m.rlike(f"^(?:{r})$")
        head = F.regexp_extract(m, r"^((?i:[a-z_-]+)\s{0,2}[=:]\s{0,2}[\"']?)", 1)
        secret = F.substring(m, F.length(head) + 1, F.length(m))
        title = F.regexp_extract(m, r"^(\p{L}+\.? )", 1)
        gender = F.when(title.rlike(rf"^(?:{FEMALE})[. ]"), "FIRST_F").when(title.rlike(rf"^(?:{NEUTRAL})[. ]"), "FIRST").otherwise("FIRST_M")
        host = F.substring_index(m, "@", -1)
        tld = F.regexp_extract(host, r"(\.[^.]*)$", 1)
        local, domain = F.substring_index(m, "@", 1), F.substring(host, F.lit(1), F.length(host) - F.length(tld))
        called = F.substring(m, F.length(title) + 1, F.length(m))
        first = F.regexp_extract(called, rf"^({NAME}) ", 1)
        last = F.regexp_extract(called, r"([^ ]+)$", 1)
        # what stands between the first name and the last: a space, with words such as "de la"
        between = F.substring(called, F.length(first) + 1, F.length(called) - F.length(first) - F.length(last))
        # one entity in capitals and not
        plain = F.when(last == F.upper(last), F.initcap(F.lower(last))).otherwise(last)
        code = F.when(m.startswith("00"), F.substring(m, F.lit(3), F.length(m))).otherwise(m)
        return (
            F.when(full(EMAIL), F.array(s(local, F.lit("LOCAL"), F.lower(local)), s(F.lit("@")), s(domain, F.lit("DOMAIN"), F.lower(domain)), s(tld)))
            .when(full(ASSIGNED), F.array(s(head), s(secret, F.lit("SECRET"), secret)))
            .when(full(ACCESS_KEY), F.array(s(m, F.lit("ACCESS_KEY"), m)))
            .when(full(IBAN), F.array(s(m, F.lit("IBAN"), F.regexp_replace(m, " ", ""))))
            .when(full(IP6), F.array(s(m, F.lit("IP6"), F.lower(m))))
            .when(full(IP), F.array(s(m, F.lit("IP"), m)))
            .when(full(CARD), F.array(s(m, F.lit("CARD"), digits(m))))
            .when(full(SSN), F.array(s(m, F.lit("SSN"), digits(m))))
            .when(full(PHONE), F.array(s(F.substring(m, F.lit(1), F.length(m) - F.length(code))), s(code, F.lit("PHONE"), F.concat(F.when(m.startswith("+") | m.startswith("00"), "+").otherwise(""), digits(code)))))
            .when(full(LOGIN_FORM), F.array(s(F.regexp_extract(m, "^([^:]*:)", 1)), s(F.regexp_extract(m, "^[^:]*:(.*)$", 1), F.lit("SECRET"), F.regexp_extract(m, "^[^:]*:(.*)$", 1))))
            .when(F.length(first) > 0, F.array(s(title), s(first, gender, first), s(between), s(last, F.lit("LAST"), plain)))
            .otherwise(F.array(s(F.concat(title, between)), s(last, F.lit("LAST"), plain)))
        )

    found = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    gaps = F.split(text, ANY, -1)
    return F.flatten(F.zip_with(gaps, found, lambda g, m: F.when(m.isNull(), F.array(s(g))).otherwise(F.concat(F.array(s(g)), one(m)))))


def _pick(letters: str, byte: Column) -> Column:
    return F.substring(F.lit(letters), (byte % len(letters)).cast("int") + 1, F.lit(1))


def _surrogate(kind: Column, norm: Column, nonce: Column, key: str) -> Column:
    """The nonce-th draw for an entity, in its normal form."""
    stream = F.concat_ws("", F.transform(F.sequence(F.lit(0), (F.length(norm) / 60).cast("int") + 1), lambda r: F.sha2(F.concat_ws("\u0001", F.lit(key), kind, norm, nonce.cast("string"), r.cast("string")), 512)))
    byte = lambda i: F.conv(F.substring(stream, (2 * i + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
    hexed = kind == "IP6"
    wide = nonce >= WIDE
    longer = F.when(wide, F.substring(stream, 101, 8)).otherwise("")

    def letters(text: Column, shift: int = 0) -> Column:
        def one(i: Column) -> Column:
            c, b = F.substring(text, i.cast("int"), F.lit(1)), byte(i + shift)
            return F.when(c.between("0", "9"), _pick(DIGITS, b)).when(hexed & c.between("a", "f"), _pick("abcdef", b)).when(c.between("a", "z"), _pick(LOWER, b)).when(c.between("A", "Z"), _pick(UPPER, b)).otherwise(c)

        return F.when(F.length(text) > 0, F.concat_ws("", F.transform(F.sequence(F.lit(1), F.length(text)), one))).otherwise("")

    n = F.length(norm)
    octet = lambda o, i: F.when(wide, byte(2 * i + 1) % 254 + 1).when(F.length(o) == 1, byte(i + 1) % 9 + 1).when(F.length(o) == 2, byte(i + 1) % 90 + 10).otherwise(byte(i + 1) % 156 + 100)
    ip = F.concat_ws(".", F.transform(F.split(norm, r"\."), lambda o, i: octet(o, i).cast("string")))

    # groups of four, whatever they were: short addresses can't run out
    ip6 = F.when(wide, F.concat_ws(":", F.transform(F.split(norm, ":"), lambda g, i: F.when(g == "", g).otherwise(F.substring(stream, (4 * i + 1).cast("int"), F.lit(4)))))).otherwise(letters(norm))

    def luhn(text: Column) -> Column:  # the sum that is divisible by 10 in a valid number
        last = F.length(text)
        d = lambda i: F.substring(text, i.cast("int"), F.lit(1)).cast("int")
        return F.aggregate(F.transform(F.sequence(F.lit(1), last), lambda i: F.when((last - i) % 2 == 1, F.when(d(i) > 4, 2 * d(i) - 9).otherwise(2 * d(i))).otherwise(d(i))), F.lit(0), lambda a, x: a + x)

    body = F.concat(F.substring(norm, 1, 1), letters(F.substring(norm, F.lit(2), n - 2), 1))
    check = ((10 - luhn(F.concat(body, F.lit("0"))) % 10) % 10).cast("string")
    card = F.concat(body, F.when(luhn(norm) % 10 == 0, check).otherwise(_pick(DIGITS, byte(n))))
    country = F.length(F.regexp_extract(norm, COUNTRY, 0))
    phone = F.concat(F.substring(norm, F.lit(1), country), _pick("23456789", byte(F.lit(1))), letters(F.substring(norm, country + 2, n), 2))

    def name(script: str) -> Column:
        syl, male, female, last = SYLLABLES[script]
        table = F.array(*map(F.lit, syl))
        made = F.concat_ws("", F.transform(F.sequence(F.lit(1), (F.lit(3) + nonce / 2).cast("int")), lambda i: F.element_at(table, ((byte(2 * i) * 256 + byte(2 * i + 1)) % len(syl) + 1).cast("int"))))
        return F.initcap(F.concat(made, F.when(kind == "FIRST_M", male).when(kind == "FIRST_F", female).otherwise(last)))

    names = F.when(norm.rlike(r"\p{IsCyrillic}"), name("cyrillic")).when(norm.rlike(r"\p{IsGreek}"), name("greek")).otherwise(name("latin"))
    fixed = F.when(kind == "ACCESS_KEY", F.concat(F.substring(norm, 1, 4), letters(F.substring(norm, F.lit(5), n), 4)))
    return fixed.when(kind.isin("LOCAL", "DOMAIN", "SECRET"), F.concat(letters(norm), longer)).when(kind == "IP", ip).when(kind == "CARD", card).when(kind == "PHONE", phone).when(kind == "IBAN", F.concat(F.substring(norm, 1, 2), letters(F.substring(norm, F.lit(3), n), 2))).when(kind == "IP6", ip6).when(kind == "SSN", letters(norm)).otherwise(names)


def surrogates(entities: DataFrame, key: str = KEY, rounds: int = 40) -> DataFrame:
    """kind, norm, made for distinct (kind, norm): surrogates without collisions.

    In each round, of the entities that share a surrogate all but the smallest draw again, and
    so do those whose surrogate is an entity of the same type.
    """
    table = settle(entities.distinct().withColumn("nonce", F.lit(0)).withColumn("made", _surrogate(F.col("kind"), F.col("norm"), F.col("nonce"), key)))
    known = table.select(F.col("kind").alias("k"), F.col("norm").alias("n"))
    for _ in range(rounds):
        owner = table.groupBy("kind", "made").agg(F.min("norm").alias("owner"))
        bad = table.join(owner, ["kind", "made"]).join(known, (F.col("k") == F.col("kind")) & (F.col("n") == F.col("made")), "left")
        bad = bad.withColumn("again", (F.col("owner") != F.col("norm")) | F.col("n").isNotNull())
        if bad.where("again").isEmpty():
            return table.select("kind", "norm", "made")
        nonce = F.col("nonce") + F.col("again").cast("int")
        table = settle(bad.select("kind", "norm", nonce.alias("nonce"), F.when(F.col("again"), _surrogate(F.col("kind"), F.col("norm"), nonce, key)).otherwise(F.col("made")).alias("made")))
    raise RuntimeError("surrogates still collide")


def _laid_out(lit: Column, kind: Column, made: Column) -> Column:
    """A surrogate in the writing of the original: its separators, or its upper case."""
    own = F.when(kind == "PHONE", F.regexp_replace(made, "[^0-9]", "")).otherwise(made)
    spread = F.aggregate(F.split(lit, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("k")), lambda a, c: F.struct(F.when(c.rlike("[0-9A-Za-z]"), F.concat(a.out, F.substring(own, a.k + 1, F.lit(1)))).otherwise(F.concat(a.out, c)).alias("out"), (a.k + c.rlike("[0-9A-Za-z]").cast("int")).alias("k"))).out
    cased = F.concat_ws("", F.zip_with(F.split(lit, ""), F.split(made, ""), lambda o, m: F.when(o.between("A", "Z"), F.upper(m)).otherwise(m)))
    return F.when(kind.isin("CARD", "PHONE", "SSN", "IBAN"), spread).when(kind.isin("LOCAL", "DOMAIN", "IP6"), F.when(lit == F.lower(lit), made).otherwise(cased)).when((kind == "LAST") & (lit == F.upper(lit)), F.upper(made)).otherwise(made)


def replace_entities(docs: DataFrame, key: str = KEY, text: str = "text", count: str | None = None) -> DataFrame:
    """`docs` with surrogates in the texts, all columns kept; `count` names a column for the number of entities."""
    has = F.coalesce(F.col(text).rlike(HINT) & F.col(text).rlike(ANY), F.lit(False))
    free = docs.where(~has)
    mine = settle(docs.where(has).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text).alias("_text"), F.sha2(F.col(text).cast("binary"), 256).alias("_key")))
    cut = mine.dropDuplicates(["_key"]).select("_key", F.posexplode(_pieces(F.col("_text"))).alias("pos", "piece")).select("_key", "pos", "piece.*")
    cut = settle(cut)
    made = surrogates(cut.where("kind is not null").select("kind", "norm"), key)
    name = F.when(F.col("kind").startswith("FIRST") | (F.col("kind") == "LAST"), F.struct(F.col("lit").alias("was"), _laid_out(F.col("lit"), F.col("kind"), F.col("made")).alias("now")))
    whole = cut.join(made, ["kind", "norm"], "left").select("_key", "kind", name.alias("name"), F.struct("pos", F.coalesce(_laid_out(F.col("lit"), F.col("kind"), F.col("made")), F.col("lit")).alias("out")).alias("part"))
    whole = whole.groupBy("_key").agg(F.array_sort(F.collect_list("part")).alias("parts"), F.array_sort(F.collect_set("name")).alias("names"), F.count(F.when(F.col("kind") != "DOMAIN", 1)).alias("_n"))
    # a name found after a title goes wherever else it stands in the text
    again = lambda t, x: F.regexp_replace(t, F.concat(F.lit(r"(?<!\p{L})"), x.was, F.lit(r"(?!\p{L})")), x.now)
    whole = whole.select("_key", F.aggregate("names", F.concat_ws("", F.col("parts.out")), again).alias("_new"), "_n")
    out = mine.join(whole, "_key")
    cols = [F.col("_new").alias(text) if c == text else F.col("_row")[c].alias(c) for c in docs.columns]
    if count in docs.columns:
        raise ValueError(f"a column {count} is there already")
    out = out.select(*cols, *([F.col("_n").alias(count)] if count else []))
    return free.select("*", *([F.lit(0).cast("long").alias(count)] if count else [])).unionByName(out)


def entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """kind, norm of every entity found."""
    parts = docs.where(F.col(text).rlike(ANY)).select(F.explode(_pieces(F.col(text))).alias("p")).select("p.kind", "p.norm")
    return parts.where("kind is not null")

