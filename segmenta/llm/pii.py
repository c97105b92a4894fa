"""Surrogate generation for personal data, in DataFrame functions alone.

Detected are e-mail addresses, IPv4 addresses, card numbers, phone numbers, US social security numbers, secrets (long
hexadecimal strings) and names after a title.  Every entity is brought to a canonical form (case, separators and leading
zeros removed), and every canonical form gets one surrogate for the whole table, drawn from a hash of a key, its type,
itself and a salt: the same entity is replaced alike everywhere, however it is written.  A surrogate is of the same type:

* digits become digits, letters letters of the same alphabet, and separators, length and case of the occurrence stay;
* an e-mail's domain becomes one under a reserved name, the same for every address of that domain;
* a card number keeps its first digit, and stays valid if it was; a phone number keeps its country code;
* a given name becomes one of the same gender and script, a surname one of the same script, each by itself, so that
  "Mr. A B" and "Mr. B" still share their surname; every further salt lengthens them by a name or a syllable, so that
  they never run out.

Collision check: as long as two entities of a type share a surrogate, or a surrogate is itself an entity of the table,
all but the smallest take the next salt.  So distinct entities stay distinct, and nobody's real data is a surrogate.  Where
a format has too few values for that (one-letter addresses of a domain, short telephone numbers), every salt above
``SAME_LENGTH`` makes a surrogate longer by a letter or digit, so there is always one more and no table is refused.

How: documents that may hold an entity are marked by one regular expression and stored; entities, surrogates and their
written forms are tables joined by equality; a document is put together from its own pieces and its own map.  All other
documents pass untouched.

Defined cases: NULL text stays NULL with no entities; repeated rows stay separate; NULL doc_id is kept; other columns
are kept (n_entities is replaced); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Private-use characters between pieces; where a text holds them itself they are escaped.
CUT, SLOT, ESCAPE = "\ue000", "\ue001", "\ue002"

#: Titles that tell a gender.
MALE = "Mr|Herr|Herrn|Monsieur|Señor|Don|г-н|κ"
FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Señorita|Doña|г-жа|κα"
_NAME = r"\p{Lu}\p{Ll}{1,30}"


def _after(titles: str) -> str:
    return rf"(?<=(?<![\p{{L}}])(?:{titles})\.?[ ])"


_ANY = f"{MALE}|{FEMALE}"
#: (type, pattern), in order of precedence.
DETECTORS = [
    ("email", r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+"),
    ("secret", r"(?<![\p{L}\p{N}])(?=[A-Fa-f]*[0-9])[0-9A-Fa-f]{32,}(?![\p{L}\p{N}])"),
    ("ssn", r"(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}-])"),
    ("ipv4", r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])(?![\p{L}\p{N}]|\.[0-9])"),
    ("card", r"(?<![\p{L}\p{N}+-])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![\p{L}\p{N}]|-[0-9])"),
    ("phone", r"(?<![\p{L}\p{N}+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}|\([0-9]{3}\)[ ]?[0-9]{3}[ .-][0-9]{4}"
              r"|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![\p{L}\p{N}])"),
    ("given_m", _after(MALE) + rf"{_NAME}(?=[ ]{_NAME})"),
    ("given_f", _after(FEMALE) + rf"{_NAME}(?=[ ]{_NAME})"),
    ("surname", rf"(?:{_after(_ANY)}|(?<=(?<![\p{{L}}])(?:{_ANY})\.?[ ]{_NAME}[ ])){_NAME}"),
]
MAY_HOLD = rf"[@0-9]|(?:{_ANY})\.?[ ]\p{{Lu}}"
#: Salts for which a surrogate keeps its entity's length.
SAME_LENGTH = 4
_MASTER = "|".join(f"({p})" for _, p in DETECTORS)

#: Given names by script and gender, and syllables of surnames by script.
GIVEN = {
    ("latin", "given_m"): "Adam Albert Anton Bruno Carl David Edgar Emil Felix Henry Hugo Ivan Jonas Julius Karl Leo Lucas Martin Max Oscar Otto Paul Peter Robert Simon Theo Victor Walter",
    ("latin", "given_f"): "Ada Agnes Alma Anna Bella Carla Clara Diana Edith Elena Emma Eva Frida Greta Helen Ida Iris Julia Lara Laura Lena Lucia Maria Nora Olga Rosa Sara Vera",
    ("cyrillic", "given_m"): "Антон Борис Виктор Глеб Денис Егор Иван Лев Марк Олег Павел Роман Степан Тимур Фёдор Юрий",
    ("cyrillic", "given_f"): "Алла Анна Вера Галина Дарья Елена Зоя Инна Лидия Мария Нина Ольга Римма Софья Тамара Юлия",
    ("greek", "given_m"): "Άρης Γιάννης Δήμος Ηλίας Θάνος Κώστας Λουκάς Μάρκος Νίκος Πέτρος Σπύρος Τάσος",
    ("greek", "given_f"): "Άννα Βάσω Δήμητρα Ελένη Ζωή Ηρώ Ιωάννα Καίτη Λένα Μαρία Νίκη Σοφία",
}
SYLLABLES = {"latin": "bar bel cor dan del fen gar hal ker lan mar nor ost pel ran sol tam ven wil zor", "cyrillic": "бар вел гор дан кел лан мор нов пет рад сол тар",
             "greek": "βαρ γελ δαν κορ λαν μαρ νικ πελ ραν σολ ταμ"}
LETTERS = {"latin1": "àáâäåæçèéêëìíîïñòóôöøùúûü", "cyrillic": "абвгдежзиклмнопрстуфхц", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}


def _list(words: str) -> str:
    return "array(" + ", ".join(f"'{w}'" for w in words.split()) + ")"


def _pick(words: str, number: str) -> str:
    return f"element_at({_list(words)}, cast({number} % {len(words.split())} + 1 as int))"


def _more(words: str, between: str) -> str:
    """As many further words as the salt says, each from a hash of its own."""
    number = "cast(conv(substr(sha2(concat(seed, '|more|', j), 256), 1, 12), 16, 10) as bigint)"
    return f"if(salt = 0, '', array_join(transform(sequence(1, salt), j -> concat('{between}', {_pick(words, number)})), ''))"


def _script(text: str) -> str:
    return rf"case when {text} rlike '\\p{{IsCyrillic}}' then 'cyrillic' when {text} rlike '\\p{{IsGreek}}' then 'greek' else 'latin' end"


def _marked(text: Column) -> Column:
    """The text cut into pieces: plain, entity, plain, ...; an entity is its groups, of which one is not empty."""
    safe = F.replace(F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "2")), F.lit(CUT), F.lit(ESCAPE + "0")), F.lit(SLOT), F.lit(ESCAPE + "1"))
    slots = SLOT.join(f"${i}" for i in range(1, len(DETECTORS) + 1))
    return F.split(F.regexp_replace(safe, _MASTER, CUT + slots + CUT), CUT)


def _plain(text: str) -> str:
    for a, b in ((ESCAPE + "1", SLOT), (ESCAPE + "0", CUT), (ESCAPE + "2", ESCAPE)):
        text = f"replace({text}, '{a}', '{b}')"
    return text


def _entities(pieces: DataFrame) -> DataFrame:
    """(piece, type, raw, canon) of distinct pieces."""
    types = "array(" + ", ".join(f"'{t}'" for t, _ in DETECTORS) + ")"
    slots = pieces.withColumn("slots", F.split("piece", SLOT)).withColumn("at", F.expr("array_position(transform(slots, x -> x != ''), true)")) \
        .withColumn("raw", F.expr("slots[cast(at - 1 as int)]")).withColumn("type", F.expr(f"element_at({types}, cast(at as int))"))
    digits = r"regexp_replace(raw, '[^0-9]', '')"
    canon = rf"""case type when 'email' then lower(raw) when 'secret' then lower(raw)
        when 'ipv4' then array_join(transform(split(raw, '[.]'), x -> cast(cast(x as int) as string)), '.')
        when 'phone' then concat(regexp_extract(raw, '^\\+([0-9]{{1,3}})(?=[ .(-])', 1), '|',
                                 substr({digits}, length(regexp_extract(raw, '^\\+([0-9]{{1,3}})(?=[ .(-])', 1)) + 1))
        when 'card' then {digits} when 'ssn' then {digits} else raw end"""
    return slots.withColumn("canon", F.expr(canon)).select("piece", "type", "raw", "canon")


def _letters(text: str, stream: str) -> str:
    """Each character of text, replaced by one of its kind that the stream picks."""
    v = f"conv(substr({stream}, 2 * i + 1, 2), 16, 10)"
    others = " ".join(f"when instr('{chars}', c) > 0 or c rlike '{rx}' then substr('{chars}', cast({v} % {len(chars)} + 1 as int), 1)" for chars, rx in (
        (LETTERS["latin1"], r"[\\u00c0-\\u024f]"), (LETTERS["cyrillic"], r"\\p{IsCyrillic}"), (LETTERS["greek"], r"\\p{IsGreek}")))
    return rf"""array_join(transform(split({text}, ''), (c, i) -> case when c rlike '[0-9]' then cast(cast({v} % 10 as int) as string)
        when c rlike '[a-z]' then substr('abcdefghijklmnopqrstuvwxyz', cast({v} % 26 + 1 as int), 1) {others} else c end), '')"""


def _surrogate(table: DataFrame, key: str) -> DataFrame:
    """(type, canon, salt) with the canonical surrogate that the key and the salt give."""
    extra = f"greatest(salt - {SAME_LENGTH}, 0)"
    seeded = table.withColumn("seed", F.concat_ws("|", F.lit(key), "type", "canon", F.col("salt").cast("string"))) \
        .withColumn("grown", F.expr(f"if(type = 'email', concat(substring_index(canon, '@', 1), repeat('x', {extra})), concat(canon, repeat('0', {extra})))")) \
        .withColumn("stream", F.expr("array_join(transform(sequence(0, length(grown) div 64), j -> sha2(concat(seed, '|', j), 512)), '')")) \
        .withColumn("first", F.expr("cast(conv(substr(stream, 1, 12), 16, 10) as bigint)")) \
        .withColumn("second", F.expr("cast(conv(substr(stream, 13, 12), 16, 10) as bigint)")).withColumn("script", F.expr(_script("canon")))
    hexes = "array_join(transform(split(grown, ''), (c, i) -> if(c rlike '[0-9]', cast(cast(conv(substr(stream, 2 * i + 1, 2), 16, 10) % 10 as int) as string), " \
            "substr('abcdef', cast(conv(substr(stream, 2 * i + 1, 2), 16, 10) % 6 + 1 as int), 1))), '')"
    domain = "regexp_extract(canon, '@(.*)$', 1)"
    label = f"concat('d', substr(sha2(concat('{key}|domain|', {domain}), 256), 1, 9))"
    email = f"concat({_letters('grown', 'stream')}, '@', {label}, '.example.', " \
            f"if({domain} rlike '[.](com|net|org)$', regexp_extract({domain}, '([a-z]+)$', 1), 'com'))"
    octets = "array_join(transform(sequence(0, 3), i -> cast(cast(if(i = 0, 1 + conv(substr(stream, 1, 4), 16, 10) % 223, " \
             "conv(substr(stream, 4 * i + 1, 4), 16, 10) % 256) as int) as string)), '.')"
    octets = f"concat({octets}, if({extra} > 0, concat(':', substr(cast(first as string), 1, {extra})), ''))"
    # doubled at every second place from the right; a number is valid if the sum ends in 0
    def luhn(s: str) -> str:
        d = f"cast(substr({s}, length({s}) - i + 1, 1) as int)"
        return f"aggregate(sequence(1, length({s})), 0, (a, i) -> a + if(i % 2 = 0, if({d} > 4, 2 * {d} - 9, 2 * {d}), {d}))"
    card = f"concat(substr(canon, 1, 1), substr({_letters('grown', 'stream')}, 2))"
    phone = f"concat(substring_index(canon, '|', 1), '|', {_letters('substring_index(grown, ' + chr(39) + '|' + chr(39) + ', -1)', 'stream')})"
    given = " ".join(f"when type = '{kind}' and script = '{script}' then concat({_pick(names, 'first')}, {_more(names, '-')})" for (script, kind), names in GIVEN.items())
    surname = " ".join(f"when type = 'surname' and script = '{script}' then initcap(concat({_pick(s, 'first')}, {_pick(s, 'second')}, {_pick(s, 'shiftright(first, 16)')}, {_more(s, '')}))"
                       for script, s in SYLLABLES.items())
    out = seeded.withColumn("card", F.expr(card)) \
        .withColumn("card", F.expr(f"if(type = 'card' and {luhn('canon')} % 10 = 0, concat(substr(card, 1, length(card) - 1), "
                                   f"(10 - {luhn('concat(substr(card, 1, length(card) - 1), ' + chr(39) + '0' + chr(39) + ')')} % 10) % 10), card)"))
    return out.withColumn("sur", F.expr(f"case when type = 'email' then {email} when type = 'secret' then {hexes} when type = 'ipv4' then {octets} "
                                        f"when type = 'phone' then {phone} when type = 'card' then card when type = 'ssn' then {_letters('grown', 'stream')} {given} {surname} end")) \
        .select("type", "canon", "salt", "sur")


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(type, canon, sur): one surrogate for every distinct (type, canon), all distinct and none of them an entity."""
    current = stored(_surrogate(entities.select("type", "canon").distinct().withColumn("salt", F.lit(0)), key), "surrogates")
    while True:  # surrogates grow, so the rounds end
        shared = current.groupBy("type", "sur").agg(F.min("canon").alias("owner"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        real = current.select(F.col("type").alias("t2"), F.col("canon").alias("c2"))
        clash = current.join(shared, ["type", "sur"]).filter("canon != owner").select("type", "canon") \
            .union(current.join(real, (F.col("type") == F.col("t2")) & (F.col("sur") == F.col("c2")), "left_semi").select("type", "canon")).distinct()
        if clash.isEmpty():
            return current.select("type", "canon", "sur")
        again = current.join(clash.withColumn("again", F.lit(1)), ["type", "canon"], "left")
        moved = _surrogate(again.filter("again = 1").select("type", "canon", (F.col("salt") + 1).alias("salt")), key)
        current = stored(again.filter("again is null").select("type", "canon", "salt", "sur").union(moved), "surrogates")


def _written(entities: DataFrame) -> DataFrame:
    """(piece, out): the surrogate in the layout of the occurrence."""
    laid = "aggregate(split(raw, ''), named_struct('k', 1, 'o', ''), (a, c) -> if(c rlike '[0-9A-Za-z]', named_struct('k', a.k + 1, " \
           "'o', concat(a.o, if(c rlike '[A-Z]', upper(substr(flat, a.k, 1)), substr(flat, a.k, 1)))), named_struct('k', a.k, 'o', concat(a.o, c))), a -> concat(a.o, substr(flat, a.k)))"
    mail = "if(upper(raw) = raw and lower(raw) != raw, upper(sur), concat(array_join(transform(split(substring_index(raw, '@', 1), ''), (c, i) -> " \
           "if(c = lower(c), substr(sur, i + 1, 1), upper(substr(sur, i + 1, 1)))), ''), substr(substring_index(sur, '@', 1), length(substring_index(raw, '@', 1)) + 1), " \
           "'@', substring_index(sur, '@', -1)))"
    return entities.withColumn("flat", F.expr("replace(sur, '|', '')")) \
        .withColumn("out", F.expr(f"case when type = 'email' then {mail} when type in ('secret', 'phone', 'card', 'ssn') then {laid} else sur end")) \
        .select("piece", "out")


def pseudonymise(docs: DataFrame, key: str = "change-me") -> DataFrame:
    """The documents, all columns kept, with surrogates in their texts, and n_entities (occurrences replaced)."""
    if "'" in key or "\\" in key:
        raise ValueError("the key must not hold quotes or backslashes")
    may = F.coalesce(F.col("text"), F.lit("")).rlike(MAY_HOLD)
    rest = docs.filter(~may).withColumn("n_entities", F.lit(0).cast("long"))
    marked = stored(docs.filter(may).withColumn("__pieces", _marked(F.col("text"))).withColumn("__key", F.xxhash64("doc_id", "text")), "marked")
    met = marked.select("doc_id", "__key", F.explode(F.expr("array_distinct(filter(__pieces, (p, i) -> i % 2 = 1))")).alias("piece"))
    entities = stored(_entities(met.select("piece").distinct()), "entities")
    out = _written(entities.join(surrogates(entities, key), ["type", "canon"]))
    maps = met.join(out, "piece").groupBy(F.col("doc_id").alias("__id"), F.col("__key").alias("__k")) \
        .agg(F.map_from_entries(F.collect_set(F.struct("piece", "out"))).alias("__map"))
    text = F.expr(_plain("array_join(transform(__pieces, (p, i) -> if(i % 2 = 0, p, __map[p])), '')"))
    done = marked.join(maps, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__k")), "left") \
        .withColumn("text", F.when(F.col("__map").isNull(), F.col("text")).otherwise(text)) \
        .withColumn("n_entities", F.expr("cast(size(__pieces) div 2 as bigint)"))
    columns = [c for c in docs.columns if c != "n_entities"] + ["n_entities"]
    return done.select(*columns).union(rest.select(*columns))
