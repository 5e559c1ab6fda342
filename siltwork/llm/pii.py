"""Keyed surrogates for personal data and secrets. DataFrame functions only.

Entities are found by one pattern; each mention becomes a surrogate of the same type, format, script and,
for names, gender. A surrogate depends on a secret key and the entity's normal form alone, so all mentions
of an entity, in any document and notation, agree. The words of a name are entities of their own, given names and surnames, so
that a full name and a surname alone agree too. A collision check over the distinct entities gives
entities that would share a surrogate, or whose surrogate is an entity of the corpus, another draw.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltwork.llm.common import hot_bound, meet, save

# Titles by gender, in Latin and Cyrillic script; given names that show a gender.
MALE_TITLES = ("Mr", "Mister", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Don", "господин", "Господин")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mademoiselle", "Señora", "Sra", "Doña", "госпожа", "Госпожа")
OTHER_TITLES = ("Dr", "Prof", "Doctor", "Professor")
MALE_NAMES = ("James", "John", "Robert", "Michael", "William", "David", "Richard", "Thomas", "Hans", "Peter", "Karl", "Jürgen", "Pierre", "Jean", "Michel", "Luc", "José", "Carlos", "Juan", "Miguel")
FEMALE_NAMES = ("Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Susan", "Sarah", "Emma", "Anna", "Ursula", "Greta", "Heidi", "Marie", "Sophie", "Claire", "Camille", "Carmen", "Lucía", "Elena", "Isabel")
MALE_NAMES_CYRILLIC = ("Иван", "Пётр", "Сергей", "Алексей", "Дмитрий", "Николай", "Андрей", "Павел")
FEMALE_NAMES_CYRILLIC = ("Анна", "Мария", "Елена", "Ольга", "Наталья", "Ирина", "Татьяна", "Светлана")

_NAME = r"\p{Lu}[\p{L}'’-]+"
_TITLE = "|".join((*MALE_TITLES, *FEMALE_TITLES, *OTHER_TITLES))
_GIVEN = "|".join((*MALE_NAMES, *FEMALE_NAMES, *MALE_NAMES_CYRILLIC, *FEMALE_NAMES_CYRILLIC))
#: Patterns by type, tried in this order at each place. Groups repeat a bounded number of times or possessively: the engine
#: recurses at each turn of any other, which very long texts would not survive.
TYPES = {
    "jwt": r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+",
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}_%+-]++(?:\.[\p{L}\p{N}_%+-]++)*+@(?:[A-Za-z0-9-]{1,63}+\.){1,126}[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "secret": r"(?i:(?<=key)|(?<=token)|(?<=secret)|(?<=password)|(?<=passwd))(?:\s{0,3}[=:]\s{0,3})[\"']?(?=[A-Za-z_/+=.-]*[0-9])[A-Za-z0-9_/+=.-]{8,}[\"']?|(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|(?:sk|pk)[-_][A-Za-z0-9_-]{16,}|gh[pousr]_[A-Za-z0-9]{20,}|[0-9a-f]{40}|[0-9a-f]{64})(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ipv4": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d.])(?:\d{4}[ -]){3}\d{1,7}(?!\d)|(?<![\d.])\d{13,19}(?!\d)",
    "phone": r"(?<![\d\p{L}+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\d\p{L}])(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?!\d)",
    "name": rf"(?<![\p{{L}}])(?:(?:(?:{_TITLE})\.? ){{1,3}}(?:{_NAME})(?: {_NAME}){{0,2}}|(?:{_GIVEN}) {_NAME})(?![\p{{L}}])",
}
PATTERN = "|".join(f"(?:{p})" for p in TYPES.values())
#: A title or given name at the start of a word; what starts with no capital is passed over by its first character.
_NAMED = rf"(?=[A-ZА-Яг])(?<!\p{{L}})(?:{_TITLE}|{_GIVEN})\.? \p{{Lu}}"
#: What a token may start with that holds no digit.
_TOKEN = r"AKIA|[sp]k[-_]|gh[pousr]_|[a-f]{40}"
#: Types of the words of a name.
WORDS = ("given_m", "given_f", "given", "surname")
_LATIN = ("ba be bi bo da de di do fa fe fi ga go ha he ka ke ki ko la le li lo ma me mi mo na ne ni no pa pe po ra re ri ro sa se so ta te ti to va ve vi za zo".split(), ("s", "n", "r", "l", "m", "k", "t", "d"))
_CYRILLIC = ("ба бе би бо да де ди до фа га го ка ке ки ко ла ле ли ло ма ме ми мо на не ни но па пе по ра ре ри ро са се со та те ти то ва ве ви за зо".split(), ("в", "н", "р", "л", "м", "к", "т", "с"))


def mentions(text: Column) -> Column:
    """Mentions of a text in order; none for null."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    # every type but names and the tokens of _TOKEN has a digit, an @ or eyJ
    possible = t.rlike("[0-9@]") | t.contains("eyJ") | t.rlike(_TOKEN) | t.rlike(_NAMED)
    return F.when(possible, F.regexp_extract_all(t, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))


def kind(mention: Column) -> Column:
    """The first type whose pattern is the whole mention."""
    out = None
    # a secret is known by what stands before it, which the mention alone doesn't show
    tests = {**TYPES, "secret": r"\s{0,3}[=:].*|(?:AKIA|sk[-_]|pk[-_]|gh[pousr]_).*|[0-9a-f]{40}|[0-9a-f]{64}"}
    for name, p in tests.items():
        hit = mention.rlike(f"(?s)^(?:{p})$")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("other")


def normal(mention: Column, of: Column) -> Column:
    """What all notations of an entity share."""
    digits = F.regexp_replace(mention, r"\D", "")
    return (
        F.when(of == "email", F.lower(mention))
        .when(of.isin("card", "ssn"), digits)
        .when(of == "phone", F.when(F.length(digits) == 11, F.regexp_replace(digits, "^1", "")).otherwise(digits))
        .when(of == "iban", F.regexp_replace(mention, " ", ""))
        .when(of == "secret", F.regexp_extract(mention, r"([A-Za-z0-9_/+=.-]{8,})[\"']?$", 1))
        .when(of.isin(*WORDS), F.lower(mention))
        .otherwise(mention)
    )


def _draws(key: str, what: Column, attempt: Column) -> Column:
    """128 hex digits that only the key predicts."""
    seed = F.concat_ws("\u001f", F.lit(key), attempt.cast("string"), what)
    return F.concat(F.sha2(seed, 256), F.sha2(F.concat(F.lit("+"), seed), 256))


def _number(draws: Column, at: Column, below: int) -> Column:
    """The ``at``-th number of ``draws`` below ``below``."""
    return F.pmod(F.conv(F.substring(F.concat(draws, draws), F.pmod(at * 2, F.lit(128)) + 1, F.lit(8)), 16, 10).cast("long") + F.floor(at / 64), F.lit(below))


def _with(value: Column, f) -> Column:
    """``f`` of ``value``, which is computed once, also where ``f`` uses it for each character of a text."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _like(text: Column, draws: Column, hexadecimal: Column | None = None) -> Column:
    """Each letter by a letter of its case and script, each digit by a digit; the rest stays.

    ``hexadecimal``: whether letters are to stay hexadecimal digits.
    """
    if hexadecimal is None:
        return _with(draws, lambda d: _each(text, d, None))
    return _with(F.struct(draws.alias("d"), hexadecimal.alias("x")), lambda e: _each(text, e["d"], e["x"]))


def _each(text: Column, draws: Column, hexadecimal: Column | None) -> Column:
    def one(c, i):
        n = lambda below: _number(draws, i, below).cast("int")
        pick = lambda letters: F.substring(F.lit(letters), n(len(letters)) + 1, F.lit(1))
        out = F.when(c.rlike("[0-9]"), n(10).cast("string"))
        if hexadecimal is not None:
            out = out.when(hexadecimal & c.rlike("[a-f]"), pick("abcdef"))
        out = out.when(c.rlike("[a-z]"), pick("abcdefghijklmnopqrstuvwxyz")).when(c.rlike("[A-Z]"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        out = out.when(c.rlike(r"[\p{IsCyrillic}&&\p{Lu}]"), pick("АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ")).when(c.rlike(r"\p{IsCyrillic}"), pick("абвгдежзиклмнопрстуфхцчшэюя"))
        out = out.when(c.rlike(r"\p{Lu}"), pick("ÀÂÇÉÈÊÎÔÛÄÖÜÑÁÍÓÚ")).when(c.rlike(r"\p{L}"), pick("àâçéèêîôûäöüñáíóú"))
        return out.otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _refill(mention: Column, digits: Column) -> Column:
    """``mention`` with its digits replaced by ``digits``, in order."""
    groups = F.split(mention, r"\d", -1)
    return F.array_join(F.transform(groups, lambda g, i: F.concat(g, F.substring(digits, i + 1, F.lit(1)))), "")


def _check_digit(head: Column) -> Column:
    """The digit that makes ``head`` and it pass Luhn's test."""
    n = F.length(head)
    places = F.transform(F.split(head, ""), lambda c, i: F.when(F.pmod(n - i, F.lit(2)) == 1, F.when(c.cast("int") * 2 > 9, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int")))
    total = F.aggregate(places, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10)).cast("string")


def _pick(names: tuple, n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), n.cast("int") + 1)


def _syllables(draws: Column, n: Column, script: tuple, tail: int) -> Column:
    kinds, ends = script
    some = F.transform(F.sequence(F.lit(0), n - 1), lambda j: _pick(kinds, _number(draws, j * 7 + 3, len(kinds))))
    return F.concat(F.array_join(some, ""), _pick(ends, _number(draws, F.lit(tail), len(ends))))


def _word(word: Column, of: Column, draws: Column, attempt: Column) -> Column:
    """Another given name of the gender, or an invented surname; case and script are kept.

    Given names come from the list at first; later draws, as those of surnames, are invented, longer with each draw, so that names do
    not run out.
    """
    cyrillic, she = word.rlike(r"\p{IsCyrillic}"), of == "given_f"
    more = F.least(attempt.cast("int"), F.lit(5))

    def invented(n, tail):
        return F.when(cyrillic, _syllables(draws, more + n, _CYRILLIC, tail)).otherwise(_syllables(draws, more + n, _LATIN, tail))

    def of_list(names):
        return _pick(names, _number(draws, F.lit(0), len(names)))

    end = F.when(of == "given", "").when(cyrillic & she, "а").when(cyrillic, "").when(she, "a").otherwise("o")
    listed = F.when(cyrillic & she, of_list(FEMALE_NAMES_CYRILLIC)).when(cyrillic, of_list(MALE_NAMES_CYRILLIC)).when(she, of_list(FEMALE_NAMES)).otherwise(of_list(MALE_NAMES))
    given = F.when((attempt == 0) & of.isin("given_m", "given_f"), listed).otherwise(F.initcap(F.concat(invented(2, 40), end)))
    new = F.when(of == "surname", F.initcap(invented(3, 50))).otherwise(given)
    return F.when((word == F.upper(word)) & (F.length(word) > 1), F.upper(new)).otherwise(new)


def _any(words: tuple) -> str:
    return rf"(?<!\p{{L}})(?:{'|'.join(words)})(?!\p{{L}})"


def _titles(name: Column) -> Column:
    """The titles that a name begins with, and the space after them."""
    return F.regexp_extract(name, rf"^(?:(?:{_TITLE})\.? ){{0,3}}", 0)


def parts(mention: Column, of: Column) -> Column:
    """``array<struct<type, norm, shown>>``: the entities of a mention in order, a name's words without its titles."""
    titles = _titles(mention)
    man, woman = titles.rlike(_any(MALE_TITLES)), titles.rlike(_any(FEMALE_TITLES))
    words = F.split(F.substring(mention, F.length(titles) + 1, F.length(mention)), " ")
    count = F.size(words)

    def one(w, i):
        he, she = w.isin(*MALE_NAMES, *MALE_NAMES_CYRILLIC), w.isin(*FEMALE_NAMES, *FEMALE_NAMES_CYRILLIC)
        middle = (titles != "") & (i < count - 1)
        role = F.when(he, "given_m").when(she, "given_f").when(middle & man, "given_m").when(middle & woman, "given_f").when(middle, "given").otherwise("surname")
        return F.struct(role.alias("type"), F.lower(w).alias("norm"), w.alias("shown"))

    named = F.transform(words, one)
    return F.when(of == "name", named).otherwise(F.array(F.struct(of.alias("type"), normal(mention, of).alias("norm"), mention.alias("shown"))))


def _entity_key(of: Column, norm: Column) -> Column:
    return F.concat_ws("\u001f", of, norm)


def surrogate(part: Column, attempt: Column, key: str) -> Column:
    """Surrogate of a ``struct<type, norm, shown>`` by the draw numbered ``attempt``."""
    x = F.transform(F.array(F.struct(part.alias("p"), attempt.alias("try"), _draws(key, _entity_key(part["type"], part["norm"]), attempt).alias("d"))), lambda e: _surrogate(e["p"]["shown"], e["p"]["type"], e["p"]["norm"], e["d"], e["try"], key))
    return F.get(x, F.lit(0))


def replaced(found: Column, tries: Column, key: str) -> Column:
    """``array<struct<of, new>>`` for an array of mentions; ``tries``: a map of the draws of entities that need another than the first.

    Steps are nested transforms over structs, so that each value is computed once a mention.
    """
    def new(e):
        words = F.transform(e["parts"], lambda p: surrogate(p, F.coalesce(F.try_element_at(tries, _entity_key(p["type"], p["norm"])), F.lit(0)), key))
        return F.when(e["of"] == "name", F.concat(_titles(e["m"]), F.array_join(words, " "))).otherwise(F.get(words, F.lit(0)))

    x = F.transform(found, lambda m: F.struct(m.alias("m"), kind(m).alias("of")))
    x = F.transform(x, lambda e: F.struct(e["m"].alias("m"), e["of"].alias("of"), parts(e["m"], e["of"]).alias("parts")))
    return F.transform(x, lambda e: F.struct(e["of"].alias("of"), new(e).alias("new")))


def _surrogate(mention: Column, of: Column, norm: Column, d: Column, attempt: Column, key: str) -> Column:
    # digits: those of the normal form; a country code in front of it is kept
    code = F.substring(F.regexp_replace(mention, r"\D", ""), F.lit(1), F.length(F.regexp_replace(mention, r"\D", "")) - F.length(norm))
    head = F.concat(F.substring(norm, 1, 1), F.substring(_like(norm, d), F.lit(2), F.length(norm) - 2))
    valid = _check_digit(F.substring(norm, F.lit(1), F.length(norm) - 1)) == F.substring(norm, -1, 1)
    card = F.concat(head, F.when(valid, _check_digit(head)).otherwise(_number(d, F.lit(61), 10).cast("string")))
    octets = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: (_number(d, i * 5, 254) + 1).cast("string")), ".")
    domain = F.regexp_extract(norm, r"@(.*)\.[^.]*$", 1)
    email = F.concat(_like(F.regexp_extract(mention, r"^(.*)@", 1), d), F.lit("@"), _like(domain, _draws(key, F.concat(F.lit("domain\u001f"), domain), F.lit(0))), F.regexp_extract(mention, r"(\.[^.]*)$", 1))
    at = F.length(F.regexp_extract(mention, r"^(\s{0,3}[=:]?\s{0,3}[\"']?)", 1))
    kept = F.length(F.regexp_extract(norm, r"^(AKIA|sk[-_]|pk[-_]|gh[pousr]_)", 1))
    hidden = F.concat(F.substring(norm, F.lit(1), kept), F.substring(_like(norm, d, norm.rlike("^[0-9a-f]+$")), kept + 1, F.length(norm)))
    secret = F.concat(F.substring(mention, F.lit(1), at), hidden, F.substring(mention, at + F.length(norm) + 1, F.length(mention)))
    return (
        F.when(of == "email", email)
        .when(of == "ipv4", octets)
        .when(of == "card", _refill(mention, card))
        .when(of == "ssn", _refill(mention, _like(norm, d)))
        .when(of == "phone", _refill(mention, F.concat(code, _like(norm, d))))
        .when(of == "secret", secret)
        .when(of == "iban", F.concat(F.substring(mention, 1, 2), _like(F.substring(mention, F.lit(3), F.length(mention)), d)))
        .when(of == "jwt", F.concat(F.lit("eyJ"), F.substring(_like(mention, d), F.lit(4), F.length(mention))))
        .when(of.isin(*WORDS), _word(mention, of, d, attempt))
        .otherwise(_like(mention, d))
    )


def entities(docs: DataFrame) -> DataFrame:
    """Distinct entities of all texts, ``type, norm, shown`` (one notation), and how many mentions they have."""
    m = docs.select(F.explode(mentions(F.col("text"))).alias("mention")).groupBy("mention").agg(F.count("*").alias("n"))
    m = m.withColumn("of", kind(F.col("mention"))).select("n", F.explode(parts(F.col("mention"), F.col("of"))).alias("p"))
    return m.groupBy("p.type", "p.norm").agg(F.min("p.shown").alias("shown"), F.sum("n").alias("n"))


def attempts(found: DataFrame, key: str, max_rounds: int = 20) -> DataFrame:
    """``type, norm, attempt`` of the entities that need another draw than the first, and only these.

    Each round draws for the entities that have none yet; of those with the same surrogate the smallest keeps
    it, unless it is held already or is itself an entity of the corpus; the others go on. Where a format has hardly more
    values than the corpus has entities, some may be left after ``max_rounds``: they keep the last draw, shared or not.
    """
    own = found.select("type", F.col("norm").alias("drawn"), F.lit(True).alias("own"))
    def shape(df):
        p = F.struct("type", "norm", "shown")
        return df.withColumn("drawn", surrogate(p, F.col("attempt"), key)).withColumn("drawn", normal(F.col("drawn"), F.col("type")))

    # the tables are small in bytes, the draws are not cheap: as many tasks as a shuffle has
    tasks = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = lambda df: df.repartition(tasks, "type", "norm")
    draw = save(shape(spread(found.select("type", "norm", "shown")).withColumn("attempt", F.lit(0))), "draw")
    held = None
    for k in range(1, max_rounds + 1):
        w = Window.partitionBy("type", "drawn").orderBy("norm")
        ranked = draw.withColumn("r", F.row_number().over(w)).join(own, ["type", "drawn"], "left")
        if held is not None:
            ranked = ranked.join(held.select("type", "drawn").withColumn("gone", F.lit(True)), ["type", "drawn"], "left")
        else:
            ranked = ranked.withColumn("gone", F.lit(None).cast("boolean"))
        good = (F.col("r") == 1) & F.col("own").isNull() & F.col("gone").isNull() | F.lit(k == max_rounds)
        ranked = save(ranked.withColumn("good", good), "ranked")
        won = ranked.where("good").select("type", "norm", "drawn", "attempt")
        held = won if held is None else save(held.unionByName(won), "held")
        lost = ranked.where("not good").select("type", "norm", "shown")
        if lost.isEmpty():
            break
        draw = save(shape(spread(lost).withColumn("attempt", F.lit(k))), "draw")
    return held.where("attempt > 0").select("type", "norm", "attempt")


def replace_pii(docs: DataFrame, key: str, text: str = "text", types: str = "pii_types") -> DataFrame:
    """``docs`` with every mention in ``text`` replaced, and ``types`` (array of the types, in order).

    Null text stays null; a text without mentions is returned as it is. All other columns are kept; one named like ``types`` is
    replaced, and names that start with ``__pii`` are taken. Repeated rows are treated alike; an empty table returns no rows.
    """
    plain = docs.select(F.col(text).cast("string").alias("text"))
    found = save(entities(plain), "entities")
    again = save(attempts(found, key).join(found.select("type", "norm", "n"), ["type", "norm"]), "attempts")
    out = docs.withColumn("__pii_found", mentions(F.col(text)))
    if again.isEmpty():
        out = out.withColumn("__pii_tries", F.lit(None).cast("map<string,int>"))
    else:
        # texts that hold an entity with another draw; Spark broadcasts them by size
        m = plain.select("text", F.explode(F.array_distinct(mentions(F.col("text")))).alias("mention")).select(F.md5("text").alias("__pii_text"), "mention")
        m = m.withColumn("of", kind(F.col("mention"))).select("__pii_text", F.explode(parts(F.col("mention"), F.col("of"))).alias("p")).select("__pii_text", "p.type", "p.norm").distinct()
        m = meet(save(m, "places"), again, ["type", "norm"], hot_bound(found.agg(F.sum("n")).first()[0] or 0))
        per = m.groupBy("__pii_text").agg(F.map_from_entries(F.collect_set(F.struct(_entity_key(F.col("type"), F.col("norm")).alias("e"), "attempt"))).alias("__pii_tries"))
        out = out.withColumn("__pii_text", F.when(F.size("__pii_found") > 0, F.md5(F.col(text)))).join(save(per, "tries"), "__pii_text", "left").drop("__pii_text")

    # gaps and mentions alternate
    gaps = F.split(F.col(text), PATTERN, -1)
    out = out.withColumn("__pii_made", F.when(F.size("__pii_found") > 0, replaced(F.col("__pii_found"), F.col("__pii_tries"), key)))
    new = F.array_join(F.zip_with(gaps, "__pii_made", lambda g, s: F.concat(F.coalesce(g, F.lit("")), F.coalesce(s["new"], F.lit("")))), "")
    out = out.withColumn(text, F.when(F.size("__pii_found") > 0, new).otherwise(F.col(text)))
    return out.withColumn(types, F.coalesce(F.transform("__pii_made", lambda e: e["of"]), F.array().cast("array<string>"))).drop("__pii_found", "__pii_tries", "__pii_made")
