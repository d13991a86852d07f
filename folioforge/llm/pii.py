"""Surrogates for personal data and secrets.

Detected entities (one pattern, matched from left to right): e-mail addresses, IBANs,
payment cards (first digit 2 to 6, Luhn check passed; other numbers stay), social security numbers, telephone numbers, IPv4 and IPv6 addresses, long
hex secrets and common key formats, and names. Names are found by context and shape: after a
title (of several languages and scripts), a given name of a small lexicon before a
capitalised word, words such as "my name is" before two capitalised words, or words such as
"said" after two. A name once found in a text is replaced wherever it stands in that text, and
each half of a double name too. Names without such a context anywhere in their text, in capitals
only, or as initials are not found.

An entity has a canonical form: e-mail addresses in lower case, cards, telephone and social
security numbers as digits (a country code apart, +1 dropped), IBANs without spaces. Canonical
forms get surrogates, once for the whole corpus, so all spellings of one entity share one
(coreference), which each place writes in its own format: separators, case, top-level domain,
country code, issuer digit, check digits (Luhn, modulo 97), and private address ranges stay.
Names are built from syllables of their script, with an ending of their gender; names of
the lexicon first try others of their script and gender.

A surrogate that equals another entity's, or any entity found in the corpus, is refused and
drawn again (distinctness); each attempt draws from a larger space, names from the start
from one that fits their number, so that the draws end however many entities there are.

Distinct entities are gathered with map-side aggregation. Only entities and positions are
shuffled, and the texts that hold some; texts without entities go straight through. A hot
entity is one row a task before the shuffle of the distinct ones, and is split by AQE's skew
join where surrogates go back to their places.

Null texts stay null. Rows that repeat an id are replaced each by its own text. Extra
columns stay. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.session import cut

# Given names by script and gender, titles, words around names, words that are no
# names, syllables and letters of scripts.
GIVEN = {
    "latin_m": "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Hans Pierre Carlos Miguel".split(),
    "latin_f": "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Margaret Greta Claire Lucia Carmen".split(),
    "cyrillic_m": "Иван Сергей Дмитрий Алексей Андрей Михаил Николай Владимир".split(),
    "cyrillic_f": "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана".split(),
    "greek_m": "Γιώργος Νίκος Δημήτρης Κώστας Παύλος Πέτρος".split(),
    "greek_f": "Μαρία Ελένη Σοφία Άννα Κατερίνα Ειρήνη".split(),
}
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Monsieur Madame Mme Mlle Señor Señora Sr Sra Doña г-н г-жа κύριος κυρία السيد السيدة الدكتور מר גברת श्री श्रीमती".split()
BEFORE = ["[Mm]y name is", "[Nn]amed", "[Cc]alled", "[Mm]et", "[Dd]ear", "[Ss]igned", "[Ss]incerely,", "[Rr]egards,", "[Nn]ame:", "[Cc]ontact:", "[Aa]uthor:", "m['’]appelle", "[Mm]e llamo", "[Ii]ch heiße", "Меня зовут", "меня зовут", "με λένε"]
AFTER = "said says asked told called met wrote replied answered explained lives lived works worked dit sagte schrieb dijo escribió сказал сказала написал написала είπε".split()
STOP = "The A An In On At And But Or So If As When While Then Now Here There However Yesterday Today Later Finally He She It They We You I This That My His Her Our Der Die Das Ein Eine Le La Les El Los Las Un Une Una".split()
HAN_SURNAMES = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何林高罗"
HAN_TITLES = "先生 女士 小姐 教授 博士".split()
SYLLABLES = {
    "latin": "bar cor den fal gor hal ker lin mar nor pel ros sel tam vel win".split(),
    "cyrillic": "бар вол гор дан зор кар лев мир нов пет ром сав тар фед хол щер".split(),
    "greek": "βαρ γορ δαν ζωρ καρ λεν μιρ νικ παλ ραπ σαβ ταρ φιλ χαλ ψαρ δελ".split(),
    "arabic": "بار دان فار حال كار لام مار نور رام سال شاد تام وال زين جاد هاد".split(),
    "hebrew": "בר גל דן הר זר חן טל ים כר לב מר נר סל פז רם שי".split(),
    "devanagari": "बर गल दन हर जय कर लव मन नर पल रम सर तर वन यश भर".split(),
    "han": list("安柏成德恩丰光海嘉凯乐明宁平荣思"),
    "hangul": list("가나도리마바서아우재지태하현혜호"),
}
LETTERS = {"cyrillic": "абвгдежзиклмнопрстуфхцчшщэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}
#: First octets of public IPv4 addresses.
PUBLIC = [i for i in range(1, 224) if i not in (10, 100, 127, 169, 172, 192, 198, 203)]

_CLASS = {"cyrillic": r"\p{IsCyrillic}", "greek": r"\p{IsGreek}", "arabic": r"\p{IsArabic}", "hebrew": r"\p{IsHebrew}", "devanagari": r"\p{IsDevanagari}", "han": r"\p{IsHan}", "hangul": r"\p{IsHangul}"}
_ONE = r"\p{Lu}(?:['’]\p{Lu})?[\p{Ll}\p{M}]{1,40}(?:\p{Lu}[\p{Ll}\p{M}]{1,40})?"
_END = r"(?![\p{L}\p{M}\p{N}])"
_NAME = rf"{_ONE}(?:-{_ONE})?" + _END
_CASELESS = r"[\p{IsArabic}\p{IsHebrew}\p{IsDevanagari}]{2,40}" + _END
_ALL_GIVEN = "|".join(n for names in GIVEN.values() for n in names)
_ALL_TITLES, _BEFORE, _AFTER, _STOP = "|".join(TITLES), "|".join(BEFORE), "|".join(AFTER), "|".join(STOP)
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_HEX = r"[0-9A-Fa-f]{1,4}"
#: Country codes of telephone numbers, by the first digits.
_COUNTRY = r"(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: Each kind starts where no letter or digit stands before it, but for an address of numbers.
KINDS = {
    "email": r"(?<![._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "secret": r"(?:[0-9a-f]{32,}|[0-9A-F]{32,}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{32,})(?![\p{L}\p{N}])",
    "card": r"[2-6](?:\d{3}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,7}|\d{3}[ -]\d{6}[ -]\d{5})(?!\d)",
    "ssn": r"(?<!-)\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?!\d|\.\d)",
    "ipv6": rf"(?=[0-9A-Fa-f:]*\d)(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}})(?![\p{{L}}\p{{N}}:])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
}
_TITLED = rf"(?:{_ALL_TITLES})\.? "
#: Places of names with the words that give them away, from these on, so that nothing looks back.
NAMES = [
    rf"{_TITLED}(?:\p{{Lu}}\. ?){{0,3}}(?:{_NAME}(?: {_NAME})?|{_CASELESS})",
    rf"(?=\p{{Lu}}\p{{Ll}}+ \p{{Lu}})(?:(?:{_ALL_GIVEN}) )+{_NAME}",
    rf"(?:{_BEFORE})(?: (?!(?:{_STOP}){_END}){_NAME}){{2}}",
    rf"(?=\p{{Lu}}[\p{{L}}\p{{M}}'’-]+ \p{{Lu}})(?!(?:{_STOP}){_END}){_NAME} {_NAME}(?= (?:{_AFTER}){_END})",
    r"\p{IsHangul}{2,4}(?= 씨)",
]
_HAN = rf"(?=[一-鿿])[{HAN_SURNAMES}]\p{{IsHan}}{{0,2}}?(?={'|'.join(HAN_TITLES)})"
_LOOKS = {"email": "", "iban": r"(?=[A-Z]{2}\d)", "secret": r"(?=[0-9A-Za-z_-]{20})", "card": r"(?=[2-6]\d{3})", "ssn": r"(?=\d{3}-)", "phone": r"(?=[\d(+])", "ipv6": r"(?=[0-9A-Fa-f]{1,4}:)"}


def _pattern(names: list[str]) -> str:
    """The kinds in order, each behind a cheap look at the next character or two, for nearly every
    place of a text is none of them; names last of all."""
    kinds = "|".join(f"{look}{KINDS[k]}" for k, look in _LOOKS.items())
    return rf"(?<![\p{{L}}\p{{N}}])(?:{kinds}|(?=\p{{L}})(?:{'|'.join(names)}))|(?=\d){KINDS['ip']}|{_HAN}"


PATTERN = _pattern(NAMES)
#: All entities, and every word that could be a name.
WIDE = _pattern([_ONE + _END, _CASELESS, NAMES[-1]])


def kind_of(entity: Column) -> Column:
    """The kind of a match; `none` for numbers that look like cards and fail the Luhn check."""
    kinds = {kind: F.lit(kind) for kind in KINDS}
    kinds["card"] = F.when(F.call_function("luhn_check", F.regexp_replace(entity, r"\D", "")), F.lit("card")).otherwise(F.lit("none"))
    return F.coalesce(*[F.when(entity.rlike(f"^(?:{KINDS[k]})$"), said) for k, said in kinds.items()], F.lit("name"))


def names_in(hit: Column) -> Column:
    """The names in a place of names, without the words that gave them away; double names in halves."""
    bare = F.regexp_replace(hit, rf"^(?:{_TITLED}|(?:{_BEFORE}) )", "")
    each = F.regexp_extract_all(bare, F.lit(rf"{_ONE}|[\p{{IsArabic}}\p{{IsHebrew}}\p{{IsDevanagari}}]{{2,40}}|\p{{IsHan}}+|\p{{IsHangul}}+"), F.lit(0))
    return F.filter(each, lambda w: ~w.isin([*TITLES, *STOP]))


def canonical(kind: Column, entity: Column) -> Column:
    """The form that all spellings of an entity share."""
    digits = F.regexp_replace(entity, r"\D", "")
    abroad = F.regexp_replace(digits, f"^({_COUNTRY})", "+$1 ")
    phone = F.when(~entity.startswith("+"), digits).when(digits.rlike(r"^1\d{10}$"), F.substring(digits, 2, 10)).otherwise(abroad)
    return (
        F.when(kind.isin("email", "ipv6"), F.lower(entity))
        .when(kind == "iban", F.replace(entity, F.lit(" "), F.lit("")))
        .when(kind.isin("card", "ssn"), digits)
        .when(kind == "phone", phone)
        .otherwise(entity)
    )


def _number(digest: Column, at: Column | int, size: int = 2) -> Column:
    return F.conv(F.substring(digest, at, size), 16, 10).cast("int")


def _pick(choices: str, v: Column) -> Column:
    return F.substring(F.lit(choices), v % len(choices) + 1, 1)


def _replaced(entity: Column, digest: Column, kind: Column) -> Column:
    """entity, in canonical form, with its letters and digits replaced one by one."""
    chars = F.split(entity, "")
    tail = F.when(kind == "email", F.length(F.substring_index(entity, ".", -1)) + 1).otherwise(F.lit(0))
    head = F.when(kind == "iban", F.lit(2)).when(kind == "card", F.lit(1)).when(
        kind == "phone", F.length(F.regexp_extract(entity, r"^\+\d+ ", 0))
    ).when(kind == "secret", F.length(F.regexp_extract(entity, r"^(?:AKIA|gh[pousr]_|sk-)", 0))).when(
        kind == "ipv6", F.length(F.substring_index(entity, ":", 1))
    ).otherwise(F.lit(0))
    hexes = (kind == "secret") & entity.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")

    def one(c: Column, i: Column) -> Column:
        v = _number(digest, (i * 2) % 126 + 1)
        letter = F.lower(c)
        drawn = (
            F.when(kind == "ipv6", _pick("123456789abcdef", v))
            .when(c.rlike(r"\d"), F.when(kind == "phone", (v % 8 + 2).cast("string")).otherwise((v % 10).cast("string")))
            .when(letter.rlike(r"\p{IsCyrillic}"), _pick(LETTERS["cyrillic"], v))
            .when(letter.rlike(r"\p{IsGreek}"), _pick(LETTERS["greek"], v))
            .when(hexes, _pick("abcdef", v))
            .otherwise(_pick("abcdefghijklmnopqrstuvwxyz", v))
        )
        cased = F.when(c != letter, F.upper(drawn)).otherwise(drawn)
        still = ~c.rlike(r"[\p{L}\p{Nd}]") | (i < head) | (i >= F.length(entity) - tail)
        return F.when(still, c).otherwise(cased)

    return F.array_join(F.transform(chars, one), "")


def _luhn(card: Column) -> Column:
    """card, digits only, with its last digit set so that the Luhn check holds."""
    bare = F.substring(card, F.lit(1), F.length(card) - 1)
    fits = lambda d: F.call_function("luhn_check", F.concat(bare, d.cast("string")))
    return F.concat(bare, F.filter(F.sequence(F.lit(0), F.lit(9)), fits)[0].cast("string"))


def _mod97(text: Column) -> Column:
    """The remainder of letters as 10 to 35, and digits, read as one number."""
    step = lambda n, c: F.when(c.rlike(r"\d"), (n * 10 + F.ascii(c) - 48) % 97).otherwise((n * 100 + F.ascii(c) - 55) % 97).cast("int")
    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _iban(real: Column, drawn: Column) -> Column:
    """drawn with check digits that hold if those of the real one do."""
    part = lambda x, a, n=40: F.substring(x, a, n)
    valid = _mod97(F.concat(part(real, 5), part(real, 1, 4))) == 1
    check = F.lpad((98 - _mod97(F.concat(part(drawn, 5), part(drawn, 1, 2), F.lit("00")))).cast("string"), 2, "0")
    return F.when(valid, F.concat(part(drawn, 1, 2), check, part(drawn, 5))).otherwise(drawn)


def _ip(entity: Column, digest: Column, attempt: int) -> Column:
    octet = lambda i: (_number(digest, 4 * i + 1, 4) % 254 + 1).cast("string")
    public = F.element_at(F.array(*map(F.lit, PUBLIC)), _number(digest, 1, 4) % len(PUBLIC) + 1).cast("string")
    tail = F.concat_ws(".", octet(1), octet(2), octet(3))
    private = entity.rlike(r"^(?:10|127|192\.168|169\.254|172\.(?:1[6-9]|2\d|3[01]))\.")
    kept = (
        F.when(entity.rlike(r"^192\.168\.|^169\.254\."), F.concat_ws(".", F.substring_index(entity, ".", 2), octet(2), octet(3)))
        .when(entity.rlike(r"^172\."), F.concat_ws(".", F.lit("172"), (_number(digest, 5, 4) % 16 + 16).cast("string"), octet(2), octet(3)))
        .otherwise(F.concat_ws(".", F.substring_index(entity, ".", 1), tail))
    )
    if attempt >= 4:  # the smaller private ranges may be used up
        kept = F.concat_ws(".", F.lit("10"), tail)
    return F.when(private, kept).otherwise(F.concat_ws(".", public, tail))


def _name(entity: Column, digest: Column, key: str, attempt: int, more: int) -> Column:
    script = F.coalesce(*[F.when(entity.rlike("^" + c), F.lit(s)) for s, c in _CLASS.items()], F.lit("latin"))
    of = {n: group for group, names in GIVEN.items() for n in names}
    given = F.create_map(*[F.lit(x) for pair in of.items() for x in pair])[entity]
    ending = (
        F.when((script == "latin") & ((given == "latin_f") | given.isNull() & entity.endswith("a")), "a")
        .when(given == "latin_m", "o")
        .when((script == "cyrillic") & given.isNull(), F.when(entity.rlike("(?:ва|на|ая)$"), "ова").when(entity.rlike("[ая]$"), "а").otherwise("ов"))
        .when(given == "cyrillic_f", "а")
        .when((script == "greek") & entity.rlike("ου$"), "ου")
        .when((script == "greek") & entity.rlike("ς$"), "ος")
        .when((script == "greek") & entity.rlike("[αάηήωώ]$"), "α")
        .otherwise("")
    )
    pools = F.create_map(*[x for k, v in SYLLABLES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    size = F.when((F.length(entity) <= 5) | script.isin("han", "hangul"), F.lit(2)).otherwise(F.lit(3)) + attempt + more
    syllables = F.transform(F.sequence(F.lit(1), F.least(size, F.lit(120))), lambda i: F.get(pools[script], _number(digest, i, 1)))
    built = F.initcap(F.concat(F.array_join(syllables, ""), ending))
    if attempt:
        return built
    keyed = {g: sorted(names, key=lambda n: hashlib.sha256(f"{key}/{n}".encode()).digest()) for g, names in GIVEN.items()}
    others = F.create_map(*[x for g, names in keyed.items() for x in (F.lit(g), F.array(*map(F.lit, names)))])[given]
    return F.when(given.isNotNull(), F.get(others, _number(digest, 1, 6) % F.size(others))).otherwise(built)


def surrogate(entity: Column, kind: Column, key: str, attempt: int, more: int = 0) -> Column:
    """A draw for an entity in canonical form; more: syllables beyond the least."""
    digest = F.sha2(F.concat_ws("/", F.lit(key), kind, entity, F.lit(str(attempt))), 512)
    plain = _replaced(entity, digest, kind)
    extra = max(0, attempt - 5)  # spaces that many attempts found full are widened
    if extra:
        digits = F.concat(*[(_number(digest, 127 - 2 * i) % 10).cast("string") for i in range(min(extra, 20))])
        letters = F.translate(digits, "0123456789", "abcdefghij")
        plain = F.when(kind == "email", F.concat(letters, plain)).when(kind == "ipv6", F.concat(plain, F.lit(":"), F.substring(digits, 1, 4))).otherwise(F.concat(plain, digits))
    return (
        F.when(kind == "name", _name(entity, digest, key, attempt, more))
        .when(kind == "ip", _ip(entity, digest, attempt))
        .when((kind == "card") & F.call_function("luhn_check", entity), _luhn(plain))
        .when(kind == "iban", _iban(entity, plain))
        .otherwise(plain)
    )


def rendered(kind: Column, mention: Column, entity: Column, new: Column) -> Column:
    """The surrogate `new` of `entity` in the format of a mention: its letters and digits take the
    places of the mention's, in the mention's case."""
    slot = r"[\p{L}\p{Nd}]"
    slots = F.regexp_extract_all(new, F.lit(slot), F.lit(0))
    count = lambda x: F.regexp_count(x, F.lit(slot))
    skip = F.when(kind == "phone", count(mention) - count(entity)).otherwise(F.lit(0))  # a country code that is dropped

    def put(done: Column, c: Column) -> Column:
        own = F.get(slots, done["k"])
        cased = F.when(c != F.lower(c), F.upper(own)).otherwise(own)
        is_slot = c.rlike(slot)
        text = F.concat(done["text"], F.when(is_slot & (done["k"] >= 0), F.coalesce(cased, c)).otherwise(c))
        return F.struct(text.alias("text"), (done["k"] + is_slot.cast("int")).alias("k"))

    def whole(done: Column) -> Column:
        rest = F.slice(slots, F.greatest(done["k"], F.lit(0)) + 1, F.greatest(F.size(slots) - done["k"], F.lit(0)))
        return F.concat(done["text"], F.array_join(rest, ""))

    filled = F.aggregate(F.split(mention, ""), F.struct(F.lit("").alias("text"), (-skip).alias("k")), put, whole)
    as_it_is = kind.isin("name", "ip") | (kind.isin("email", "ipv6") & (F.length(new) != F.length(entity)))
    return F.when(as_it_is, new).otherwise(filled)


def assign_surrogates(entities: DataFrame, key: str, attempts: int = 60) -> DataFrame:
    """kind, entity and surrogate of all entities (distinct kind, entity; in canonical form)."""
    named = entities.where("kind = 'name'").count()
    more = max(0, math.ceil(math.log(max(named, 1), 16)) - 1)  # so that most first draws are free
    real = entities.select(F.col("entity").alias("surrogate")).distinct()
    pending, done = entities, []
    for attempt in range(attempts):
        free = pending.withColumn("surrogate", surrogate(F.col("entity"), F.col("kind"), key, attempt, more)).join(real, "surrogate", "left_anti")
        for taken in done:
            free = free.join(taken.select("surrogate"), "surrogate", "left_anti")
        first = free.groupBy("surrogate").agg(F.min(F.struct("kind", "entity")).alias("e"))
        done.append(cut(first.select("e.kind", "e.entity", "surrogate")))
        pending = cut(pending.join(done[-1], ["kind", "entity"], "left_anti"))
        if pending.isEmpty():
            return reduce(DataFrame.unionByName, done)
    raise RuntimeError(f"{attempts} attempts found no free surrogate for some entities")


def replace_entities(docs: DataFrame, key: str = "folioforge", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with surrogates in place of entities, and n_entities, the number of places."""
    text, every = F.col(text_col), lambda pattern: F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(0))
    hits = docs.withColumn("__ff_hits", every(PATTERN)).where(F.size("__ff_hits") > 0)
    is_name = lambda e: kind_of(e) == "name"
    names = F.flatten(F.transform(F.filter("__ff_hits", is_name), names_in))
    # the texts that hold entities are kept, so that the pattern runs over all texts once for them
    holding = cut(hits.withColumn("__ff_hash", F.xxhash64(text)).withColumn("__ff_names", F.array_distinct(names)))
    named = F.exists("__ff_hits", is_name)
    slim = holding.select(F.col(id_col).alias("id"), F.col("__ff_hash").alias("hash"), "__ff_names", F.when(named, every(WIDE)).otherwise(F.col("__ff_hits")).alias("all"))
    places = slim.select("id", "hash", F.posexplode("all").alias("pos", "mention")).withColumn("kind", kind_of(F.col("mention")))
    places = cut(places.withColumn("entity", canonical(F.col("kind"), F.col("mention"))))
    own = slim.select("id", "hash", F.explode("__ff_names").alias("entity")).distinct()
    # entities are few bytes but much work each: AQE would put them into one task
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = places.where("kind not in ('name', 'none')").select("kind", "entity").unionByName(own.select(F.lit("name").alias("kind"), "entity")).distinct()
    known = assign_surrogates(cut(found.repartition(parts)), key)
    own = own.join(known.where("kind = 'name'").drop("kind"), "entity").select(F.col("id").alias("own_id"), F.col("hash").alias("own_hash"), F.col("entity").alias("own"), "surrogate")
    others = places.where("kind not in ('name', 'none')").join(known, ["kind", "entity"])
    others = others.select("id", "hash", "pos", rendered(F.col("kind"), F.col("mention"), F.col("entity"), F.col("surrogate")).alias("new"), F.lit(1).alias("hit"))
    words = places.where("kind in ('name', 'none')")
    words = words.join(own, words["id"].eqNullSafe(own["own_id"]) & (words["hash"] == own["own_hash"]) & (words["entity"] == own["own"]), "left")
    words = words.select("id", "hash", "pos", F.coalesce("surrogate", "mention").alias("new"), F.when(F.col("surrogate").isNotNull(), 2).otherwise(0).alias("hit"))
    swaps = others.unionByName(words).groupBy(F.col("id").alias("__ff_id"), F.col("hash").alias("__ff_of")).agg(F.sort_array(F.collect_set(F.struct("pos", "new", "hit"))).alias("__ff_new"))
    joined = holding.join(swaps, holding[id_col].eqNullSafe(swaps["__ff_id"]) & (holding["__ff_hash"] == swaps["__ff_of"]))
    joined = joined.withColumn("__ff_gaps", F.when(named, F.split(text, WIDE, -1)).otherwise(F.split(text, PATTERN, -1)))
    # both halves of a double name are one place
    half = lambda i: (F.get("__ff_gaps", i) == "-") & (F.coalesce(F.get("__ff_new", i - 1)["hit"], F.lit(0)) == 2)
    counted = F.filter(F.transform("__ff_new", lambda x, i: (x["hit"] > 0) & ~((x["hit"] == 2) & half(i))), lambda x: x)
    pieces = F.zip_with("__ff_gaps", "__ff_new", lambda gap, x: F.concat(gap, F.coalesce(x["new"], F.lit(""))))
    changed = joined.withColumn("n_entities", F.size(counted).cast("long")).withColumn(text_col, F.array_join(pieces, ""))
    columns = [c for c in docs.columns if c != "n_entities"]
    same = docs.where(~F.coalesce(text.rlike(PATTERN), F.lit(False))).withColumn("n_entities", F.lit(0).cast("long"))
    return changed.select(*columns, "n_entities").unionByName(same.select(*columns, "n_entities"))
