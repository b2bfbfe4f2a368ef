"""PII surrogates (operator 9), in DataFrame operations only.

Entities are found by fixed patterns, so matches don't overlap: mail addresses, phone numbers
(international and common national forms), IPv4 and IPv6 addresses, card numbers, IBANs, social
security numbers, and names: after one or more titles, or after a common given name. A name is any
number of words (two more at most after an untitled given name, two in all after a title in capitals),
with hyphens, apostrophes, inner capitals and particles; initials and particles stay as they are. In a
text with names, further mentions of their words are entities, too, alone or in a run of capitalised
words, in whatever case. ``COMMON_WORDS``, which are names but also ordinary words, count only after a
title or beside another name. Words are looked up by binary search in the text's sorted names, so the
time is not quadratic in them.

Each distinct entity (its kind and normalised form, so spellings of one entity are one) gets a
surrogate from a keyed SHA-256, character by character within the class of each character: digits stay
digits, letters keep case and script, everything else stays. Octets stay within a byte and keep their
number of digits, cards that pass the Luhn check still do, IBANs keep their country and get right check
digits. The key is a scalar subquery of one row, so plans and event logs don't show it.

A name's words (and their parts between hyphens) are entities of their own: the last word as a surname,
the others as given names. So "Mr Smith" and "John Smith" share the last word's surrogate, and a given
name has one surrogate, whatever titles it bears. Its gender is what most of its titles in the corpus
say, else that of a common given name, else drawn. Given names come from lists of that gender and
script as long as they last, then from letters with an ending of the gender.

Collision checks: a surrogate that two entities share, or that is itself an entity of the corpus, is
kept only by the smallest entity (none, if it is an entity); the others try the next attempt number,
until all are distinct. From attempt ``LOOSE`` on, forms get longer (octets: any byte), so there is
always room. Every occurrence of an entity gets the same surrogate, in its own format.

Only texts with an entity that needed another attempt, or whose gender the corpus told, take part in a
join, by their hash, so ids may repeat or be null. They are counted first: up to ``MAX_BROADCAST`` they
are broadcast, and beyond it all texts with entities are shuffled once.

Cases: null texts stay null; texts without entities are unchanged. No rows give no rows. Only the
named columns are read; the result has the id, the text and a count for each kind.
"""

from __future__ import annotations

from functools import reduce
from hashlib import sha256
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.support import written

#: The attempt from which surrogates may be longer than their entity.
LOOSE = 3
#: Texts with further attempts up to which their table is broadcast.
MAX_BROADCAST = 100_000
#: Titles by gender, and surrogate names by script and gender.
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Señora", "Sra", "Госпожа")
MALE_TITLES = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин")
NEUTRAL_TITLES = ("Dr", "Prof")
NAMES = {
    ("latin", "f"): ("Ada", "Alma", "Berta", "Carla", "Clara", "Daria", "Edith", "Elena", "Emma", "Erika", "Flora", "Greta", "Hanna", "Helga", "Ines", "Irene", "Julia", "Karin", "Laura", "Lena", "Lucia", "Marta", "Nadia", "Nora", "Olga", "Paula", "Petra", "Rita", "Rosa", "Sofia", "Vera", "Wilma"),
    ("latin", "m"): ("Adam", "Albert", "Anton", "Bruno", "Carlos", "Daniel", "David", "Diego", "Emil", "Erik", "Felix", "Franz", "Georg", "Gustav", "Henri", "Hugo", "Ivan", "Jakob", "Jonas", "Karl", "Leo", "Louis", "Lukas", "Marco", "Martin", "Max", "Oscar", "Pablo", "Paul", "Peter", "Simon", "Victor"),
    ("cyrillic", "f"): ("Анна", "Вера", "Дарья", "Елена", "Зоя", "Ирина", "Лидия", "Мария", "Нина", "Ольга", "Раиса", "София", "Тамара", "Ульяна", "Юлия", "Яна"),
    ("cyrillic", "m"): ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Лев", "Максим", "Никита", "Олег", "Пётр", "Роман", "Степан", "Юрий"),
}
#: Endings of further given names by script and gender.
ENDINGS = {("latin", "f"): ("a", "ina", "ella"), ("latin", "m"): ("o", "us", "ard"), ("cyrillic", "f"): ("а", "ина", "ия"), ("cyrillic", "m"): ("ан", "ор", "ий")}
LATIN_LOWER, LATIN_UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ACCENTED_LOWER, ACCENTED_UPPER = "àáâäçèéêëíîïñóôöùúûü", "ÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ"
CYRILLIC_LOWER, CYRILLIC_UPPER = "абвгдежзиклмнопрстуфхцчшэюя", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"
GREEK_LOWER, GREEK_UPPER = "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"

#: Common given names by gender, beside those above.
GIVEN = {
    "f": ("Alice", "Amy", "Andrea", "Anna", "Anne", "Barbara", "Camille", "Carmen", "Catherine", "Charlotte", "Claire", "Elizabeth", "Emily", "Eva", "Hannah", "Heidi", "Isabel", "Jane", "Jennifer", "Jessica", "Karen", "Katharina", "Kate", "Linda", "Lisa", "Lucy", "Margaret", "Maria", "Marie", "Mary", "Monika", "Nancy", "Natalia", "Nicole", "Patricia", "Pilar", "Sabine", "Sandra", "Sara", "Sarah", "Susan", "Teresa", "Theresa", "Ursula", "Екатерина", "Наталья", "Светлана", "Татьяна"),
    "m": ("Alexander", "Andreas", "Andrew", "Antonio", "Benjamin", "Brian", "Charles", "Christian", "Christopher", "Edward", "Fernando", "François", "George", "Hans", "Heinrich", "Henry", "Jack", "James", "Jan", "Javier", "Jean", "John", "José", "Joseph", "Juan", "Jürgen", "Kevin", "Klaus", "Luis", "Manuel", "Matthew", "Matthias", "Michael", "Miguel", "Nicolas", "Pedro", "Philippe", "Pierre", "Richard", "Robert", "Sebastian", "Stefan", "Steven", "Thomas", "Werner", "William", "Wolfgang", "Александр", "Алексей", "Дмитрий", "Сергей"),
}
#: Small words within names, and names that are ordinary words as well (in lower case).
PARTICLES = ("von", "van", "de", "der", "den", "del", "della", "di", "da", "dos", "du", "la", "le", "zu", "zur", "ter", "ten", "bin", "ibn", "al", "el")
COMMON_WORDS = ("april", "august", "baker", "bell", "berg", "bill", "bishop", "black", "brown", "bush", "cook", "day", "fischer", "flora", "fox", "gold", "grace", "gray", "green", "hill", "hope", "hunter", "joy", "june", "king", "knight", "koch", "lake", "lang", "long", "mark", "marsh", "mason", "may", "miller", "moon", "page", "park", "price", "rich", "rose", "sommer", "stone", "summer", "the", "vogel", "von", "west", "white", "will", "winter", "wolf", "wood", "young")

KINDS = ("email", "phone", "ip", "ip6", "card", "iban", "ssn", "person")
MAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\.?\d)"
_HEX = "[0-9A-Fa-f]{1,4}"
IP6 = rf"(?<![:.\p{{L}}\p{{N}}])(?=[A-Fa-f:]*\d)(?:(?:{_HEX}:){{7}}{_HEX}|{_HEX}(?::{_HEX}){{0,5}}::(?:{_HEX}(?::{_HEX}){{0,5}})?)(?![:\p{{L}}\p{{N}}])"
CARD = r"(?<!\d)(?:\d{4}[ -]?){3}\d{4}(?!\d)"
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = r"\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}-\d{4}(?!\d)"
NATIONAL = r"(?<![\p{L}\p{N}.,+-])(?:0\d(?: \d\d){4}|0\d{2,4}[ -]\d{3,4}[ -]\d{3,4}|\(?0\d{1,4}\)?[ /]\d{5,8}|\d{3}[-.]\d{3}[-.]\d{4})(?![\p{L}\p{N}-]|[.,]\d)"
NUMBERS = f"{MAIL}|(?=[0-9+(])(?:{IP}|{CARD}|{PHONE}|{SSN}|{NATIONAL})|(?=[0-9A-Fa-f]{{1,4}}:){IP6}|(?=[A-Z]{{2}}\\d){IBAN}"


def _either(words: tuple[str, ...]) -> str:
    """An alternation that tries one branch for each first letter."""
    first = lambda w: w[0]
    return "|".join(f"{c}(?:{'|'.join(w[1:] for w in sorted(of, key=len, reverse=True))})" for c, of in groupby(sorted(set(words)), first))


_TITLES = (*FEMALE_TITLES, *MALE_TITLES, *NEUTRAL_TITLES)
_TITLE = _either(_TITLES)
_SHOUTED = _either(tuple(t.upper() for t in _TITLES))
_START = r"(?<![\p{L}\p{N}])"
#: A word of a name. What follows an apostrophe is in capitals, so that a genitive's s is not of it.
WORD = r"(?:[dl]['’])?\p{Lu}[\p{L}\p{M}]*+(?:['’]\p{Lu}[\p{L}\p{M}]*+|-\p{L}[\p{L}\p{M}]*+)*+"
_MORE = rf"(?:(?:{'|'.join(PARTICLES)}) )*(?:\p{{Lu}}\. )*{WORD}"
TITLED = rf"{_START}(?:(?:(?:{_TITLE})\.? )+{_MORE}(?: {_MORE})*|(?:(?:{_SHOUTED})\.? )+\p{{Lu}}[\p{{Lu}}'’-]+(?: \p{{Lu}}[\p{{Lu}}'’-]+)?(?!\p{{L}}))"
LISTED = {sex: tuple(dict.fromkeys((*GIVEN[sex], *(n for (_, s), names in NAMES.items() if s == sex for n in names)))) for sex in "fm"}
UNTITLED = rf"{_START}(?:{_either(LISTED['f'] + LISTED['m'])})(?:-{WORD})?(?: {_MORE}){{1,2}}"
PERSON = f"{TITLED}|{UNTITLED}"
PATTERN = f"{NUMBERS}|{PERSON}"
#: With runs of capitalised words, in which further mentions are looked for.
RUNS = rf"{PATTERN}|{_START}{WORD}(?: (?!(?:{_TITLE}|{_SHOUTED})\.? ){_MORE})*"
#: What every entity but a name holds.
DIGIT_OR_AT = "[0-9@]"
_HEAD = rf"^((?:(?:{_TITLE}|{_SHOUTED})\.? )*)"
_FULL = rf"^(?:{UNTITLED})$"

#: word: as it stands there, sep: what stands before it, vote: 1 if a title says female, -1 if male.
PART = "struct<kind:string,norm:string,sep:string,word:string,vote:int>"
ENTITY = f"array<struct<kind:string,parts:array<{PART}>>>"
#: What a word is in a text's names, in order of preference: last of a full name, given name, a name alone.
SURNAME, FIRST, ALONE = 0, 1, 2
LEXICON = "array<struct<name:string,role:int>>"


def kind_of(surface: Column) -> Column:
    return (
        F.when(F.contains(surface, F.lit("@")), "email")
        .when(~surface.rlike(r"\d"), "person")
        .when(F.contains(surface, F.lit(":")), "ip6")
        .when(surface.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip")
        .when(surface.rlike(r"^[A-Z]"), "iban")
        .when(surface.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(surface.rlike(r"^(\d{4}[ -]?){4}$"), "card")
        .otherwise("phone")
    )


def norm_of(kind: Column, surface: Column) -> Column:
    """What spellings of one entity share: digits of numbers, lower case of addresses."""
    return F.when(kind.isin("phone", "card", "ssn"), F.regexp_replace(surface, r"\D", "")).when(kind == "iban", F.replace(surface, F.lit(" "), F.lit(""))).otherwise(F.lower(surface))


def _vote(title: Column) -> Column:
    """1 or -1 if one of the titles tells the gender, the first that does."""
    words = F.filter(F.split(F.upper(title), r"\.? "), lambda w: w.isin(*(t.upper() for t in (*FEMALE_TITLES, *MALE_TITLES))))
    return F.when(F.get(words, F.lit(0)).isin(*(t.upper() for t in FEMALE_TITLES)), 1).when(F.size(words) > 0, -1).otherwise(0)


def _is_name(word: Column) -> Column:
    """Whether a word of a name is neither a particle nor an initial."""
    return ~word.rlike(rf"^(?:{'|'.join(PARTICLES)})$") & ~word.rlike(r"^\p{Lu}\.$")


def pieces(name: Column) -> Column:
    """The words of a name and their parts between hyphens: sep, word, lower-cased name (null: stays as it is), last (in the last word)."""

    def of(words: Column) -> Column:
        def each(word: Column, i: Column) -> Column:
            sep = lambda j: F.when(j > 0, "-").when(i > 0, " ").otherwise("")
            return F.transform(F.split(word, "-"), lambda p, j: F.struct(sep(j).alias("sep"), p.alias("word"), F.when(_is_name(p) & _is_name(word), F.lower(p)).alias("name"), (i == F.size(words) - 1).alias("last")))

        return F.flatten(F.transform(words, each))

    return let(F.split(name, " "), of)


def _parted(surface: Column, use) -> Column:
    """``use(title, pieces)`` of a mention."""

    def of(title: Column) -> Column:
        return let(pieces(F.substring(surface, F.length(title) + 1, F.length(surface))), lambda found: use(title, found))

    return let(F.regexp_extract(surface, _HEAD, 1), of)


def _full(found: Column) -> Column:
    """Whether a name has a word before its last one."""
    return F.exists(found, lambda p: ~p["last"] & p["name"].isNotNull())


def lexicon(text: Column) -> Column:
    """The words of a text's titled and untitled names in order, each with what it is."""

    def one(surface: Column) -> Column:
        role = lambda full, p: F.when(~full, ALONE).when(p["last"], SURNAME).otherwise(FIRST)
        return _parted(surface, lambda title, found: let(_full(found), lambda full: F.transform(F.filter(found, lambda p: p["name"].isNotNull()), lambda p: F.struct(p["name"].alias("name"), role(full, p).alias("role")))))

    found = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(PERSON), F.lit(0)), one))
    return F.when(text.rlike(PERSON), F.sort_array(found)).otherwise(F.array().cast(LEXICON))


def looked_up(table: Column, steps: Column, field: str, value: Column) -> Column:
    """The first entry of a table sorted by ``field`` with that value (null: none), by binary search. steps: of :func:`steps_of`."""
    below = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(table, at + step - 1)[field] < value, at + step).otherwise(at))
    return let(F.get(table, below), lambda e: F.when(e[field] == value, e))


def steps_of(table: Column) -> Column:
    """The powers of two up to a table's size, falling."""
    return F.filter(F.array(*(F.lit(1 << k) for k in range(30, -1, -1))), lambda p: p <= F.size(table))


def _person_parts(surface: Column, names: Column, steps: Column) -> Column:
    """The words of a mention: given names and a surname by place in a full name, else by the text's names. Without a title or common given name, only words of those names count."""

    def part(p: Column, kind: Column, vote: Column, sep: Column | None = None) -> Column:
        return F.struct(kind.alias("kind"), F.when(kind != "word", p["name"]).alias("norm"), (p["sep"] if sep is None else sep).alias("sep"), p["word"].alias("word"), vote.cast("int").alias("vote"))

    def of(title: Column, found: Column) -> Column:
        sep = lambda p, i: F.when(i == 0, title).otherwise(p["sep"])
        told = title != ""
        placed = lambda p, i: part(p, F.when(p["name"].isNull(), "word").when(p["last"], "surname").otherwise("given"), F.when(p["last"], 0).otherwise(_vote(title)), sep(p, i))

        def searched(roles: Column) -> Column:
            strong = F.exists(roles, lambda r: r["role"].isNotNull() & ~r["name"].rlike(rf"^(?:{'|'.join(COMMON_WORDS)})$"))

            def each(some: Column) -> Column:
                kind = lambda p, r: F.when(r.isNull(), "word").when(~told & ~some & p["name"].rlike(rf"^(?:{'|'.join(COMMON_WORDS)})$"), "word").when(r["role"] == FIRST, "given").otherwise("surname")
                return F.transform(found, lambda p, i: let(F.get(roles, i), lambda r: part(p, kind(p, r), F.lit(0), sep(p, i))))

            return let(F.coalesce(strong, F.lit(False)), each)

        return F.when((told | surface.rlike(_FULL)) & _full(found), F.transform(found, placed)).otherwise(let(F.transform(found, lambda p: looked_up(names, steps, "name", p["name"])), searched))

    return _parted(surface, of)


def matches(text: Column, names: Column) -> Column:
    """What the pattern finds in a text: runs of capitalised words only where the text has names."""
    found = F.when(F.size(names) > 0, F.regexp_extract_all(text, F.lit(RUNS), F.lit(0))).when(text.rlike(DIGIT_OR_AT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))
    return F.coalesce(found, F.array().cast("array<string>"))


def entities(found: Column, names: Column) -> Column:
    """The matches of a text in order, with their parts; one whose parts are all plain words is no entity."""

    def each(steps: Column) -> Column:
        def one(surface: Column) -> Column:
            def of(kind: Column) -> Column:
                single = F.array(F.struct(kind.alias("kind"), norm_of(kind, surface).alias("norm"), F.lit("").alias("sep"), surface.alias("word"), F.lit(0).alias("vote")))
                return F.struct(kind.alias("kind"), F.when(kind == "person", _person_parts(surface, names, steps)).otherwise(single).alias("parts"))

            return let(kind_of(surface), of)

        return F.transform(found, one)

    return let(steps_of(names), each)


def is_entity(e: Column) -> Column:
    return F.exists(e["parts"], lambda p: p["kind"] != "word")


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def key_column(spark: SparkSession, key: str) -> Column:
    """The hashed key as a scalar subquery of one row, whose value plans don't show."""
    return spark.sql(f"VALUES ('{sha256(key.encode()).hexdigest()}')").scalar()


def _stream(key: Column, kind: Column, norm: Column, attempt: Column) -> Column:
    """64 pseudo-random bytes as hex, keyed on both sides of the message so that it can't be extended."""
    message = F.concat_ws("\x1f", key, kind, norm, attempt.cast("string"))
    return F.sha2(F.concat(key, F.sha2(message.cast("binary"), 512)).cast("binary"), 512)


def _byte(stream: Column, i: Column) -> Column:
    """Two bytes of the stream, from the i-th on, as a number; it wraps around after 64."""
    return F.conv(F.substring(stream, F.pmod(i * 2, F.lit(124)) + 1, F.lit(4)), 16, 10).cast("int")


def _pick(chars: str, n: Column) -> Column:
    return F.substring(F.lit(chars), F.pmod(n, F.lit(len(chars))) + 1, F.lit(1))


def _like(char: Column, n: Column) -> Column:
    """A character of the same class; letters and digits of other scripts become Latin ones."""
    sets = ((r"^[0-9]$", "0123456789"), (r"^[a-z]$", LATIN_LOWER), (r"^[A-Z]$", LATIN_UPPER), (r"^[ß-öø-ÿ]$", ACCENTED_LOWER), (r"^[À-ÖØ-Þ]$", ACCENTED_UPPER), (r"^[а-яё]$", CYRILLIC_LOWER), (r"^[А-ЯЁ]$", CYRILLIC_UPPER), (r"^[ά-ώ]$", GREEK_LOWER), (r"^[Ά-Ϋ]$", GREEK_UPPER), (r"^\p{Lu}$", LATIN_UPPER), (r"^\p{L}$", LATIN_LOWER), (r"^\p{N}$", "0123456789"))

    def of(number: Column) -> Column:
        out = char
        for pattern, chars in sets[::-1]:
            out = F.when(char.rlike(pattern), _pick(chars, number)).otherwise(out)
        return out

    return let(n, of)


def _characters(norm: Column, stream: Column) -> Column:
    return F.array_join(F.transform(F.split(norm, ""), lambda c, i: _like(c, _byte(stream, i))), "")


def _longer(attempt: Column, stream: Column, like: Column) -> Column:
    """From attempt LOOSE on, a character more for each attempt, of the class of ``like``."""
    more = F.greatest(attempt - (LOOSE - 1), F.lit(0))
    return F.when(more > 0, F.array_join(F.transform(F.sequence(F.lit(1), more), lambda i: _like(like, _byte(stream, i + 40))), "")).otherwise(F.lit(""))


def _octets(norm: Column, stream: Column, attempt: Column) -> Column:
    low = lambda o: F.when(F.length(o) == 1, 1).when(F.length(o) == 2, 10).otherwise(100)
    size = lambda o: F.when(F.length(o) == 1, 9).when(F.length(o) == 2, 90).otherwise(156)
    kept = F.transform(F.split(norm, r"\."), lambda o, i: (low(o) + F.pmod(_byte(stream, i * 2), size(o))).cast("string"))
    any_ = F.transform(F.split(norm, r"\."), lambda o, i: F.pmod(_byte(stream, i * 2), F.lit(256)).cast("string"))
    return F.array_join(F.when(attempt < LOOSE, kept).otherwise(any_), ".")


def luhn(digits: Column) -> Column:
    """The Luhn sum modulo 10; 0 for a number that passes."""
    value = lambda c, i: F.when((F.length(digits) - i) % 2 == 0, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int"))
    return F.aggregate(F.transform(F.split(digits, ""), value), F.lit(0), lambda a, x: a + x) % 10


def _card(norm: Column, stream: Column) -> Column:
    plain = _characters(norm, stream)
    head = F.substring(plain, F.lit(1), F.length(plain) - 1)
    check = F.pmod(10 - luhn(F.concat(head, F.lit("0"))), F.lit(10))
    return F.when(luhn(norm) == 0, F.concat(head, check.cast("string"))).otherwise(plain)


def _phone(norm: Column, stream: Column) -> Column:
    """The first digit of a number of more than ten, its country code, stays."""
    plain = _characters(norm, stream)
    extra = F.greatest(F.length(norm) - 10, F.lit(0))
    return F.concat(F.substring(norm, F.lit(1), extra), F.substring(plain, extra + 1, F.length(norm)))


def default_gender(norm: Column) -> Column:
    """That of a common given name, else n: it is drawn."""
    sides = {sex: F.lit(f" {' '.join(LISTED[sex]).lower()} ") for sex in "fm"}
    return let(F.concat(F.lit(" "), norm, F.lit(" ")), lambda n: F.when(F.contains(sides["f"], n), "f").when(F.contains(sides["m"], n), "m").otherwise("n"))


def _given(word: Column, told: Column, stream: Column, attempt: Column) -> Column:
    """A listed name of the gender and script, first; then letters like the name's with an ending of the gender."""
    gender = F.when(told == "n", F.when(_byte(stream, F.lit(0)) % 2 == 0, "f").otherwise("m")).otherwise(told)
    script = F.when(word.rlike(r"^\p{IsCyrillic}"), "cyrillic").otherwise("latin")

    def of(which: Column) -> Column:
        def drawn(lists: dict) -> Column:
            values = F.lit(None).cast("string")
            for (kind, sex), names in lists.items():
                values = F.when(which == f"{kind} {sex}", " ".join(names).lower()).otherwise(values)
            return let(F.split(values, " "), lambda v: F.get(v, F.pmod(_byte(stream, F.lit(2)), F.size(v))))

        letters = F.concat(_characters(word, F.substring(stream, F.lit(9), F.lit(120))), _longer(attempt, stream, F.when(which.startswith("cyrillic"), "я").otherwise("z")))
        return F.when(attempt == 0, drawn(NAMES)).otherwise(F.concat(letters, drawn(ENDINGS)))

    return let(F.concat_ws(" ", script, gender), of)


def _surname(norm: Column, stream: Column, attempt: Column) -> Column:
    return F.concat(_characters(norm, stream), _longer(attempt, stream, F.substring(norm, F.length(norm), F.lit(1))))


def _mail(norm: Column, stream: Column, attempt: Column) -> Column:
    """The top-level domain stays."""
    body = F.regexp_replace(norm, r"\.[a-z]+$", "")
    return F.concat(_longer(attempt, stream, F.lit("z")), _characters(body, stream), F.regexp_extract(norm, r"(\.[a-z]+)$", 1))


def _hexadecimal(norm: Column, stream: Column) -> Column:
    digit = lambda c, n: F.when(c.rlike("^[0-9]$"), _pick("0123456789", n)).when(c.rlike("^[a-f]$"), _pick("abcdef", n)).otherwise(c)
    return F.array_join(F.transform(F.split(norm, ""), lambda c, i: digit(c, _byte(stream, i))), "")


def mod97(text: Column) -> Column:
    """Digits and letters (A is 10) as one number, modulo 97."""
    value = lambda c: F.when(c.rlike("^[0-9]$"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(text, ""), F.lit(0), lambda n, c: let(value(c), lambda v: (n * F.when(v > 9, 100).otherwise(10) + v) % 97))


def _iban(norm: Column, stream: Column) -> Column:
    """The country stays; the check digits are those of the new number."""
    country, body = F.substring(norm, 1, 2), _characters(F.substring(norm, F.lit(5), F.length(norm)), stream)
    return let(body, lambda b: F.concat(country, F.lpad((98 - mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b))


def surrogate(kind: Column, norm: Column, gender: Column, attempt: Column, key: Column) -> Column:
    """The normalised surrogate of an entity."""

    def of(stream: Column) -> Column:
        made = F.when(kind == "email", _mail(norm, stream, attempt)).when(kind == "phone", _phone(norm, stream)).when(kind == "card", _card(norm, stream)).when(kind == "ssn", _characters(norm, stream))
        made = made.when(kind == "ip", _octets(norm, stream, attempt)).when(kind == "ip6", _hexadecimal(norm, stream)).when(kind == "iban", _iban(norm, stream))
        return made.when(kind == "given", _given(norm, gender, stream, attempt)).otherwise(_surname(norm, stream, attempt))

    return let(_stream(key, kind, norm, attempt), of)


def formatted(kind: Column, surface: Column, made: Column) -> Column:
    """A normalised surrogate in the format of an occurrence."""
    return let(made, lambda m: _formatted(kind, surface, m))


def _formatted(kind: Column, surface: Column, made: Column) -> Column:
    filled = lambda fits, other: F.array_join(F.transform(F.split(surface, ""), lambda c, i: F.when(c.rlike(fits), F.substring(made, F.length(F.regexp_replace(F.substring(surface, F.lit(1), i + 1), other, "")), F.lit(1))).otherwise(c)), "")
    cased = F.array_join(F.transform(F.split(made, ""), lambda c, i: F.when(F.substring(surface, i + 1, F.lit(1)) == F.lower(F.substring(surface, i + 1, F.lit(1))), c).otherwise(F.upper(c))), "")
    shouted = (F.length(surface) > 1) & (surface == F.upper(surface))
    out = F.when(kind.isin("phone", "card", "ssn"), filled(r"^\d$", r"\D")).when(kind == "iban", filled("^[A-Z0-9]$", "[^A-Z0-9]"))
    out = out.when(kind.isin("given", "surname") & shouted, F.upper(made)).when((kind == "given") & (surface != F.lower(surface)), F.initcap(made))
    return out.when(kind.isin("email", "surname", "ip6"), cased).otherwise(made)


def further_attempts(found: DataFrame, key: str) -> DataFrame | None:
    """(kind, norm, attempt, gender) of the distinct entities ``found`` (kind, norm, vote) whose first surrogate collides or whose gender their titles tell; None without any."""
    secret = key_column(found.sparkSession, key)
    made = lambda df, attempt: written(df.select("kind", "norm", "gender", F.lit(attempt).alias("attempt"), secret.alias("secret")).select("kind", "norm", "gender", "attempt", surrogate(F.col("kind"), F.col("norm"), F.col("gender"), F.col("attempt"), F.col("secret")).alias("made")), "tried")
    votes = F.sum("vote") if "vote" in found.columns else F.lit(0)
    told = F.when(F.col("votes") > 0, "f").when(F.col("votes") < 0, "m").otherwise(default_gender(F.col("norm")))
    found = written(found.groupBy("kind", "norm").agg(votes.alias("votes")).select("kind", "norm", F.when(F.col("kind") == "given", told).otherwise("n").alias("gender")), "entities")
    real = found.select("kind", F.col("norm").alias("made"))
    tried, won = made(found, 0), []
    while True:
        free = tried.groupBy("kind", "made").agg(F.min("norm").alias("norm")).join(real, ["kind", "made"], "left_anti")
        for earlier in won:
            free = free.join(earlier.select("kind", "made"), ["kind", "made"], "left_anti")
        judged = written(tried.join(free.withColumn("won", F.lit(True)), ["kind", "made", "norm"], "left"), "judged")
        lost = judged.filter("won is null")
        won.append(judged.filter("won"))
        if not lost.limit(1).count():
            break
        tried = made(lost, len(won))
    again = reduce(DataFrame.unionByName, won).filter((F.col("attempt") > 0) | (F.col("kind") == "given") & (F.col("gender") != default_gender(F.col("norm"))))
    return again.select("kind", "norm", "attempt", "gender") if again.limit(1).count() else None


def replace(docs: DataFrame, key: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, n_email, ...) with every entity replaced."""
    body = F.coalesce(F.col("text"), F.lit(""))
    listed = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    # Names are bound, not a column: the optimizer could put a column's expression into each mention's.
    listed = listed.withColumn("entities", let(lexicon(body), lambda names: entities(matches(body, names), names)))
    listed = listed.withColumn("some", F.exists("entities", is_entity))
    digest = F.sha2(F.col("text").cast("binary"), 256)
    own = F.filter(F.flatten(F.transform("entities", lambda e: e["parts"])), lambda p: p["kind"] != "word")
    # The digest is made before rows are: a text isn't carried along to each of its entities.
    parts = listed.select(digest.alias("digest"), own.alias("own")).select("digest", F.explode("own").alias("p"))
    again = further_attempts(parts.select("p.kind", "p.norm", "p.vote"), key)
    name = lambda kind, norm: F.concat_ws(":", kind, norm)
    if again is None:
        ready = listed.withColumn("again", F.lit(None).cast("array<struct<name:string,attempt:int,gender:string>>"))
    else:
        held = parts.select("digest", "p.kind", "p.norm").distinct()
        tables = held.join(again, ["kind", "norm"]).groupBy("digest").agg(F.sort_array(F.collect_list(F.struct(name(F.col("kind"), F.col("norm")).alias("name"), "attempt", "gender"))).alias("again"))
        tables = written(tables, "again")
        few = tables.count() <= MAX_BROADCAST
        ready = listed.withColumn("digest", F.when(F.col("some"), digest)).join(F.broadcast(tables) if few else tables, "digest", "left")
    ready = ready.withColumn("again", F.coalesce("again", F.array().cast("array<struct<name:string,attempt:int,gender:string>>"))).withColumn("secret", key_column(docs.sparkSession, key))

    def shown(p: Column, steps: Column) -> Column:
        def of(found: Column) -> Column:
            gender = F.coalesce(found["gender"], F.when(p["kind"] == "given", default_gender(p["norm"])).otherwise("n"))
            made = let(gender, lambda g: let(F.coalesce(found["attempt"], F.lit(0)), lambda attempt: surrogate(p["kind"], p["norm"], g, attempt, F.col("secret"))))
            return formatted(p["kind"], p["word"], made)

        return F.concat(p["sep"], F.when(p["kind"] == "word", p["word"]).otherwise(let(looked_up(F.col("again"), steps, "name", name(p["kind"], p["norm"])), of)))

    made = let(steps_of(F.col("again")), lambda steps: F.transform("entities", lambda e: F.array_join(F.transform(e["parts"], lambda p: shown(p, steps)), "")))
    gaps = F.when(body.rlike(PERSON), F.split(body, RUNS, -1)).otherwise(F.split(body, PATTERN, -1))
    whole = F.array_join(F.transform(F.arrays_zip(gaps.alias("gap"), made.alias("made")), lambda z: F.concat(z["gap"], F.coalesce(z["made"], F.lit("")))), "")
    count = lambda kind: F.size(F.filter("entities", lambda e: (e["kind"] == kind) & is_entity(e))).cast("long").alias(f"n_{kind}")
    return ready.select(F.col("id").alias(doc_id), F.when(F.col("some"), whole).otherwise(F.col("text")).alias("text"), *(count(k) for k in KINDS))
