"""Personal data and secrets: detected entities become keyed surrogates. DataFrame functions only.

A surrogate is a function of a secret key, the entity's kind and its normal form, so the same entity
gets the same surrogate in every document and spelling. It keeps kind, format and length where
these matter: a card number passes its check sum, a phone number keeps its country code, a name its
gender and script. The distinct entities of a corpus are checked for collisions, with each other
and with entities that really occur; of two that collide one is drawn again until none is left.
Later attempts draw from more: names get more parts, secrets, mail names and numbers more characters, and
an IPv4 address becomes a local IPv6 address. The gender of a given name is settled once for the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dnsflow.functions.binding import let
from dnsflow.llm import common

# Titles by gender and script, given names, and halves that surnames are made of.
TITLES = {
    "m": ("Mr", "Herr", "Señor", "Monsieur", "Господин", "Κύριος", "Mister", "Sir", "Lord", "Signor", "Senhor"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Señora", "Madame", "Mme", "Госпожа", "Κυρία", "Madam", "Mlle", "Lady", "Dame", "Señorita", "Signora", "Senhora"),
    "x": ("Dr", "Prof", "Doctor", "Professor", "Mx", "Доктор", "Профессор"),
}
GIVEN = {
    ("m", "latin"): ("James", "John", "Robert", "Michael", "William", "David", "Thomas", "Peter", "Hans", "Karl", "Carlos", "Pierre"),
    ("f", "latin"): ("Mary", "Anna", "Susan", "Linda", "Elizabeth", "Barbara", "Sarah", "Karen", "Greta", "Ingrid", "Carmen", "Camille"),
    ("m", "cyrillic"): ("Иван", "Пётр", "Сергей", "Алексей", "Дмитрий", "Николай"),
    ("f", "cyrillic"): ("Анна", "Мария", "Елена", "Ольга", "Татьяна", "Наталья"),
    ("m", "greek"): ("Γιώργος", "Νίκος", "Γιάννης", "Κώστας", "Δημήτρης", "Πέτρος"),
    ("f", "greek"): ("Μαρία", "Ελένη", "Κατερίνα", "Σοφία", "Άννα", "Ειρήνη"),
}
#: Given names that are found without a title, besides those above; names that are also common words are left out.
KNOWN = {
    "m": "Aaron Adam Adrian Ahmed Alan Albert Alberto Alejandro Alessandro Alexander Alexandre Alfred Ali Andreas Andrew Anthony Antoine Anton Antonio Arthur Axel "
         "Benjamin Bernard Bernd Brandon Brian Bruno Bryan Carl Charles Christian Christoph Christopher Claude Craig Daniel Dennis Diego Dieter Dmitri Donald Douglas "
         "Dylan Edgar Edward Emil Enrique Eric Erik Ethan Eugene Fabian Felix Fernando Florian Francesco Francisco Francois François Franz Frederick Friedrich Gabriel Gary Georg George "
         "Gerald Gerhard Giovanni Giuseppe Gregory Guillaume Günter Harold Hassan Heinrich Heinz Helmut Henri Henry Herbert Howard Hugo Ibrahim Igor Isaac Ivan Jacob Jacques "
         "Jakob Jan Javier Jason Jean Jeffrey Jeremy Jerry Joachim Joel Johann Johannes Johnny Jonas Jonathan Jorge Jose José Joseph Joshua Juan Julien Justin Jürgen Keith Kenneth Kevin "
         "Klaus Kurt Kyle Larry Lars Lawrence Leon Leonardo Liam Logan Louis Luca Lucas Luigi Luis Lukas Manuel Marc Marcel Marco Marcus Mario Markus Martin Mateo Matteo Matthew "
         "Matthias Maximilian Mehmet Miguel Mohamed Mohammed Muhammad Nathan Nicholas Nicolas Noah Norman Oliver Olivier Omar Oscar Otto Pablo Paolo Patrick Paul Paulo Pedro Philip Philipp "
         "Philippe Rafael Ralph Raymond Ricardo Richard Roberto Roger Roland Ronald Roy Russell Ryan Samuel Scott Sean Sebastian Sergio Simon Stefan Stephan Stephen Steven Sven Terry Theodore "
         "Thierry Timothy Tobias Tyler Uwe Victor Viktor Vincent Vladimir Walter Wayne Werner Wolfgang Xavier Yusuf Zachary",
    "f": "Abigail Agnes Alexandra Alice Alicia Alina Amanda Amelia Amy Ana Andrea Angela Anita Anne Annie Antonia Ashley Astrid Aurora Ava Beatrice Beatriz Bella Bianca Birgit Brenda "
         "Brigitte Camila Carla Carol Caroline Carolyn Catherine Cecilia Charlotte Chiara Chloe Christina Christine Claire Clara Claudia Cristina Cynthia Deborah Denise Diana Diane Donna "
         "Dorothy Elena Eleanor Elena Elisabeth Ella Ellen Emily Emma Erika Eva Evelyn Fatima Florence Frances Francesca Francoise Françoise Gabriela Gabriele Gerda Giulia Gloria Hannah Heather Heidi Helen Helena "
         "Helga Hilda Ines Irene Irina Isabel Isabella Isabelle Jacqueline Jane Janet Janice Jennifer Jessica Joan Johanna Josefine Joyce Juana Judith Julia Juliana Julie Karin Katharina Katherine Kathleen Katrin "
         "Kelly Kimberly Kristin Laura Lauren Laurence Lea Lena Leonie Lisa Lucia Lucie Lucy Luisa Madison Manon Margaret Margarita Maria María Marie Marion Marta Martha Martina Megan Melanie Melissa "
         "Mia Michelle Monica Monika Monique Nadia Nancy Natalia Natalie Nathalie Nicole Nina Nora Olga Olivia Pamela Patricia Paula Pauline Petra Rachel Rebecca Renate Rosa Ruth Sabine Samantha "
         "Sandra Sara Shirley Silvia Simone Sofia Sophia Sophie Stefanie Stephanie Susanne Svetlana Sylvia Tamara Tanja Tatiana Teresa Theresa Ursula Valentina Valeria Vanessa Veronica Victoria Virginia Vivian Wendy Yvonne Zoe",
    "m_other": "Александр Андрей Антон Артём Борис Вадим Валерий Василий Виктор Виталий Владимир Григорий Денис Евгений Егор Игорь Илья Кирилл Константин Леонид Максим Михаил Никита Олег "
               "Павел Роман Станислав Фёдор Юрий Αλέξανδρος Ανδρέας Αντώνης Βασίλης Θανάσης Κωνσταντίνος Μανώλης Μιχάλης Νικόλαος Παναγιώτης Σπύρος Σταύρος Χρήστος Γεώργιος Ιωάννης",
    "f_other": "Александра Алина Анастасия Валентина Вера Виктория Галина Дарья Евгения Екатерина Ирина Ксения Лариса Людмила Марина Надежда Нина Полина Светлана София Юлия "
               "Αικατερίνη Αναστασία Αγγελική Βασιλική Γεωργία Δήμητρα Ευαγγελία Ιωάννα Κωνσταντίνα Παναγιώτα Χριστίνα Δέσποινα Ελευθερία",
}
SURNAMES = {
    "latin": (("Ash", "Bell", "Carl", "Dan", "East", "Fair", "Gold", "Hart", "Lang", "Nor", "Stan", "West"), ("berg", "by", "field", "ford", "ley", "man", "mont", "son", "stein", "ton", "well", "wood")),
    "cyrillic": (("Берез", "Волк", "Город", "Зай", "Лес", "Мороз", "Поп", "Сокол"), ("ин", "ко", "ник", "ский", "ук", "ян")),
    "greek": (("Παπα", "Χατζη", "Καρα", "Μαυρο", "Ασπρο", "Κοντο"), ("γιώργου", "δάκης", "νικολάου", "πετρής", "στάθης", "γιάννης")),
}

_TITLE = "(?:" + "|".join(t for ts in TITLES.values() for t in ts) + ")"

_LISTED = {g: sorted({n for (gender, _), names in GIVEN.items() if gender == g for n in names} | {*KNOWN[g].split(), *KNOWN[f"{g}_other"].split()}) for g in "mf"}


def _any_of(words) -> str:
    """A pattern of the words, by their first letters."""
    by: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        by.setdefault(w[0], []).append(w[1:])
    return "(?:" + "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in by.items()) + ")"


_FIRST = _any_of(_LISTED["m"] + _LISTED["f"])
_NAME = r"\p{Lu}[\p{L}'’ʼ-]++"
_LABEL = r"(?i:password|passwd|secret|token|api[_-]?key)[ ]{0,2}[=:][ ]{0,2}[\"']?"
#: Kinds in the order in which they are tried at a place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*\.[A-Za-z]{2,}+",
    "secret": rf"(?<![A-Za-z]){_LABEL}[^\s\"'=]{{6,}}+"
              r"|(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|(?:ghp_|sk-|xox[bp]-)[A-Za-z0-9-]{16,}+|[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![A-Za-z0-9])",
    # short forms need a digit, and a group of three digits or four groups: others are slices and names in code, or loopback
    "ipv6": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"
            r"|(?<![A-Za-z0-9_:])(?=[0-9A-Fa-f]{0,4}:)(?=[A-Fa-f:]{0,40}[0-9])(?=[0-9A-Fa-f:]{0,40}[0-9A-Fa-f]{3}|(?:[0-9A-Fa-f]{0,4}:){4})(?!(?:[0-9A-Fa-f]{0,4}:){9})"
            r"(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?(?![A-Za-z0-9_:]|\.\d)",
    "ipv4": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": r"\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d+.-])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d+.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?!\d)",
    "name": rf"(?=\p{{Lu}})(?<!\p{{L}})(?:{_TITLE}\.? {_NAME}(?: {_NAME})?|{_FIRST} {_NAME})",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Any text with an entity matches this; it is far cheaper to look for.
HINT = rf"[0-9@=:]|AKIA|ghp_|sk-|xox[bp]-|[a-f]{{32}}|[A-F]{{32}}|(?=\p{{Lu}})(?<!\p{{L}})(?:{_TITLE}\.?|{_FIRST}) \p{{Lu}}"
#: From this attempt on, kinds of a fixed length get longer surrogates, so any number of entities settles.
_LONGER = 15


def _hex(kind: Column, norm: Column, attempt: Column, key: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), kind, attempt.cast("string"), norm).cast("binary"), 256)


def _number(stream: Column, at: Column | int, size: int = 4) -> Column:
    """A number from `size` hexadecimal digits, from place `at` (counted from 0) on, wrapping around."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.substr(F.concat(stream, stream), F.pmod(at, F.lit(64)) + 1, F.lit(size)), 16, 10).cast("long")


def _digits(norm: Column, stream: Column) -> Column:
    """Digits in place of digits."""
    return F.array_join(F.transform(F.split(norm, ""), lambda c, i: F.pmod(_number(stream, i * 3), F.lit(10)).cast("string")), "")


def _shaped(norm: Column, stream: Column) -> Column:
    """A digit for a digit and a letter for a letter of its case; anything else stays."""

    def one(c: Column, i: Column) -> Column:
        n = _number(stream, i * 3)
        return (
            F.when(c.between("0", "9"), F.pmod(n, F.lit(10)).cast("string"))
            .when(c.between("a", "z"), F.chr(F.pmod(n, F.lit(26)) + 97))
            .when(c.between("A", "Z"), F.chr(F.pmod(n, F.lit(26)) + 65))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(norm, ""), one), "")


def _random(stream: Column, size: Column) -> Column:
    """As many letters and digits as `size` says."""
    alphabet = F.lit("abcdefghijklmnopqrstuvwxyz0123456789")
    one = lambda i: F.substr(alphabet, (F.pmod(_number(F.sha2(F.concat(stream, i.cast("string")).cast("binary"), 256), 0, 8), F.lit(36)) + 1).cast("int"), F.lit(1))
    return F.when(size > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), one), "")).otherwise("")


def _shaped_or_random(norm: Column, attempt: Column, stream: Column) -> Column:
    """The shaped value; one with under six letters and digits is random as a whole. Attempts from the fourth on add characters."""
    few = F.length(F.regexp_replace(norm, "[^A-Za-z0-9]", "")) < 6
    return F.concat(F.when(few, _random(stream, F.length(norm))).otherwise(_shaped(norm, stream)), _random(F.reverse(stream), attempt - 3))


def _hexed(norm: Column, stream: Column) -> Column:
    """A hexadecimal digit of the same case for each one; anything else stays."""

    def one(c: Column, i: Column) -> Column:
        h = F.substr(stream, F.pmod(i, F.lit(64)) + 1, F.lit(1))
        return F.when(c.rlike("[0-9a-f]"), h).when(c.rlike("[A-F]"), F.upper(h)).otherwise(c)

    return F.array_join(F.transform(F.split(norm, ""), one), "")


def _checked(number: Column) -> Column:
    """The number with its last digit replaced by the Luhn check digit."""
    body = F.reverse(F.substr(number, F.lit(1), F.length(number) - 1))
    terms = F.transform(F.split(body, ""), lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2).otherwise(c.cast("int")))
    total = F.aggregate(terms, F.lit(0), lambda acc, x: acc + F.when(x > 9, x - 9).otherwise(x))
    return F.concat(F.substr(number, F.lit(1), F.length(number) - 1), F.pmod(F.lit(10) - total % 10, F.lit(10)).cast("string"))


def _pick(values: tuple, stream: Column, at: int) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(_number(stream, at), F.lit(len(values))) + 1).cast("int"))


def _chosen(kind: Column, sex: Column, attempt: Column, stream: Column) -> Column:
    """A surname of the kind's script, or a given name of the gender and the kind's script; later attempts join more and more with hyphens."""

    def part(k: Column) -> Column:
        return let(F.when(k == 0, stream).otherwise(F.sha2(F.concat(stream, k.cast("string")).cast("binary"), 256)), word)

    def word(own: Column) -> Column:
        out = F.lit(None).cast("string")
        for script, (heads, tails) in SURNAMES.items():
            out = F.when(kind == f"surname_{script}", F.concat(_pick(heads, own, 0), _pick(tails, own, 4))).otherwise(out)
            both = GIVEN["m", script] + GIVEN["f", script]
            for gender, names in (("m", GIVEN["m", script]), ("f", GIVEN["f", script]), ("x", both)):
                out = F.when((kind == f"given_{script}") & (F.coalesce(sex, F.lit("x")) == gender), _pick(names, own, 0)).otherwise(out)
        return out

    parts = F.when(attempt < 3, 0).when(attempt < 8, 1).otherwise(attempt - 6)
    return F.array_join(F.transform(F.sequence(F.lit(0), parts), part), "-")


def _address(norm: Column, attempt: Column, stream: Column) -> Column:
    """Groups in place of those that are not zero, of the same length; attempts from the eighth on replace all."""

    def group(g: Column, i: Column) -> Column:
        wide = attempt >= 8
        first = F.lower(F.hex(F.pmod(_number(stream, i * 7), F.lit(15)) + 1))
        digits = F.concat(first, F.substr(F.concat(stream, stream), i * 7 + 5, F.when(wide, 3).otherwise(F.length(g) - 1)))
        own = F.when(i == 0, F.concat(F.lit("fd"), F.substr(stream, F.lit(1), F.lit(2)))).otherwise(digits)
        return F.when((g == "0") & ~wide, g).otherwise(own)

    return F.array_join(F.transform(F.split(norm, ":"), group), ":")


def surrogate(kind: Column, norm: Column, gender: Column, attempt: Column, key: str) -> Column:
    """The surrogate, in normal form, of an entity in normal form; gender (m, f or x) counts for given names."""
    return let(_hex(kind, norm, attempt, key), lambda stream: _drawn(kind, norm, gender, attempt, stream, key))


def _drawn(kind: Column, norm: Column, gender: Column, attempt: Column, stream: Column, key: str) -> Column:
    domain = F.substring_index(norm, "@", -1)
    host = F.translate(F.substr(_hex(F.lit("domain"), domain, F.lit(0), key), F.lit(1), F.lit(8)), "0123456789", "ghijklmnop")
    country = F.regexp_extract(norm, r"^\+\d", 0)
    longer = F.when(attempt > _LONGER, _digits(F.repeat(F.lit("0"), attempt - _LONGER), F.reverse(stream))).otherwise("")
    local = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(29), F.lit(4)), lambda i: F.substr(F.concat(F.lit("fd"), stream), i, F.lit(4))), ":")
    octet = lambda at, low, size: (F.pmod(_number(stream, at), F.lit(size)) + low).cast("string")
    return (
        F.when(kind == "email", F.concat(_shaped(F.substring_index(norm, "@", 1), stream), _random(F.reverse(stream), attempt - 3), F.lit("@"), host, F.lit(".example.com")))
        .when(kind == "ipv4", F.when(attempt > _LONGER, local).otherwise(F.concat_ws(".", octet(0, 1, 223), octet(4, 0, 256), octet(8, 0, 256), octet(12, 1, 254))))
        .when(kind == "ipv6", _address(norm, attempt, stream))
        .when(kind == "phone", F.concat(country, _digits(F.substr(norm, F.length(country) + 1, F.length(norm)), stream), longer))
        .when(kind == "ssn", F.concat(F.lit("9"), _digits(F.substr(norm, F.lit(2), F.length(norm)), stream), longer))
        .when(kind == "card", _checked(F.concat(F.substr(norm, F.lit(1), F.lit(1)), _digits(F.substr(norm, F.lit(2), F.length(norm)), stream), longer)))
        .when(kind == "iban", F.concat(F.substr(norm, F.lit(1), F.lit(2)), _shaped(F.substr(norm, F.lit(3), F.length(norm)), stream), longer))
        .when(kind == "secret", F.when(norm.rlike("^[0-9a-fA-F]+$"), F.concat(_hexed(norm, stream), _random(F.reverse(stream), attempt - 3))).otherwise(
            F.concat(F.regexp_extract(norm, "^(AKIA|ghp_|sk-|xox[bp]-)?", 0), _shaped_or_random(F.regexp_replace(norm, "^(AKIA|ghp_|sk-|xox[bp]-)", ""), attempt, stream))))
        .otherwise(_chosen(kind, gender, attempt, stream))
    )


def kind_of(match: Column) -> Column:
    """The kind of a match: the first whose pattern fits as a whole."""
    out = F.lit("name")
    for kind in reversed([k for k in PATTERNS if k != "name"]):
        out = F.when(match.rlike(f"^(?:{PATTERNS[kind]})$"), F.lit(kind)).otherwise(out)
    return out


def _label(match: Column) -> Column:
    """What stands before a secret and is kept, or nothing."""
    return F.regexp_extract(match, f"^{_LABEL}", 0)


def _name_parts(match: Column) -> Column:
    """(title, given, surname) of a name; parts that are absent are empty."""
    title = F.regexp_extract(match, rf"^({_TITLE}\.? )", 1)
    rest = F.split(F.substr(match, F.length(title) + 1, F.length(match)), " ")
    return F.struct(
        title.alias("title"), F.when(F.size(rest) > 1, rest[0]).otherwise(F.lit("")).alias("given"),
        F.element_at(rest, -1).alias("surname"),
    )


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _listed(given: Column) -> Column:
    """The gender of a listed given name, else null."""
    return F.when(given.isin(_LISTED["m"]), "m").when(given.isin(_LISTED["f"]), "f")


def _gender(title: Column, given: Column) -> Column:
    """What a mention says about the gender: the name if it is listed, else the title."""
    of = lambda g: F.regexp_replace(title, r"\.? $", "").isin(list(TITLES[g]))
    return F.coalesce(_listed(given), F.when(of("m"), "m").when(of("f"), "f").otherwise("x"))


def _groups(match: Column) -> Column:
    """The eight groups of an IPv6 address in any spelling, lower case and without leading zeros."""
    sides = F.transform(F.split(F.lower(match), "::"), lambda side: F.filter(F.split(side, ":"), lambda g: g != ""))
    filled = let(sides, lambda s: F.when(F.size(s) < 2, s[0]).otherwise(
        F.concat(s[0], F.array_repeat(F.lit("0"), F.greatest(8 - F.size(s[0]) - F.size(s[1]), F.lit(0))), F.element_at(s, -1))))
    return F.array_join(F.transform(filled, lambda g: F.regexp_replace(g, "^0+(?=.)", "")), ":")


def _spelled(match: Column, groups: Column) -> Column:
    """An IPv6 address (its groups) as the match is spelled: padded, or shortened at the same place."""

    def shortened(g: Column) -> Column:
        count = lambda side: F.size(F.filter(F.split(side, ":"), lambda x: x != ""))
        left, right = count(F.substring_index(match, "::", 1)), count(F.substring_index(match, "::", -1))
        zero = F.forall(F.slice(g, left + 1, F.greatest(F.size(g) - left - right, F.lit(0))), lambda x: x == "0")
        short = F.concat(F.array_join(F.slice(g, F.lit(1), left), ":"), F.lit("::"), F.array_join(F.slice(g, F.size(g) - right + 1, right), ":"))
        return F.when(match.contains("::") & zero, short).otherwise(groups)

    padded = F.array_join(F.transform(F.split(groups, ":"), lambda x: F.lpad(x, 4, "0")), ":")
    return F.when(match.rlike("^[0-9A-Fa-f]{4}(:[0-9A-Fa-f]{4}){7}$"), padded).otherwise(let(F.split(groups, ":"), shortened))


def units(match: Column, kind: Column) -> Column:
    """The entities of a match, in normal form: a name has one per part, so parts corefer across mentions.

    gender is what this mention says about a given name; it is not part of the entity.
    """
    norm = (
        F.when(kind.isin("phone"), F.concat(F.when(match.startswith("+"), "+").otherwise(""), F.regexp_replace(match, r"\D", "")))
        .when(kind.isin("ssn", "card"), F.regexp_replace(match, r"\D", ""))
        .when(kind == "iban", F.regexp_replace(match, " ", ""))
        .when(kind == "email", F.lower(match))
        .when(kind == "ipv6", _groups(match))
        .when(kind == "secret", F.substr(match, F.length(_label(match)) + 1, F.length(match)))
        .otherwise(match)
    )
    unit = lambda k, n, g=F.lit(None).cast("string"): F.struct(k.alias("kind"), n.alias("norm"), g.alias("gender"))

    def of_name(parts: Column) -> Column:
        surname = unit(F.concat(F.lit("surname_"), _script(parts["surname"])), parts["surname"])
        given = unit(F.concat(F.lit("given_"), _script(parts["given"])), parts["given"], _gender(parts["title"], parts["given"]))
        return F.when(parts["given"] != "", F.array(given, surname)).otherwise(F.array(surname))

    names = let(_name_parts(match), of_name)
    return F.when(kind == "name", names).otherwise(F.array(unit(kind, norm)))


def _laid(match: Column, characters: Column, pattern: str) -> Column:
    """The characters laid, in order, over those of the match that fit the pattern."""
    place = lambda i: F.length(F.regexp_replace(F.substr(match, F.lit(1), i + 1), f"[^{pattern}]", ""))
    return F.array_join(
        F.transform(F.split(match, ""), lambda c, i: F.when(c.rlike(f"[{pattern}]"), F.substr(characters, place(i), F.lit(1))).otherwise(c)), ""
    )


def replaced(match: Column, facts: Column, key: str) -> Column:
    """What stands in place of a match; facts: map of kind|norm to attempt and gender, for entities whose attempt is not 0 or gender not known from the lists."""

    def drawn(unit: Column) -> Column:
        of = lambda fact: surrogate(
            unit["kind"], unit["norm"], F.coalesce(_listed(unit["norm"]), fact["gender"], F.lit("x")), F.coalesce(fact["attempt"], F.lit(0)), key
        )
        return let(F.element_at(facts, F.concat_ws("|", unit["kind"], unit["norm"])), of)

    def placed(kind: Column, parts: Column) -> Column:
        """parts: the surrogates of all units."""
        first = parts[0]
        name = F.concat(_name_parts(match)["title"], F.array_join(parts, " "))
        return (
            F.when(kind == "name", name)
            .when(kind.isin("phone", "ssn", "card"), let(F.regexp_replace(first, r"\D", ""), lambda digits: F.concat(
                _laid(match, digits, "0-9"), F.substr(digits, F.length(F.regexp_replace(match, r"\D", "")) + 1, F.length(digits)))))
            .when(kind == "iban", F.concat(_laid(match, first, "A-Z0-9"), F.substr(first, F.length(F.regexp_replace(match, " ", "")) + 1, F.length(first))))
            .when(kind == "secret", F.concat(_label(match), first))
            .when(kind.isin("email", "ipv6") & (match == F.upper(match)) & (match != F.lower(match)), F.upper(F.when(kind == "ipv6", _spelled(match, first)).otherwise(first)))
            .when(kind == "ipv6", _spelled(match, first))
            .otherwise(first)
        )

    return let(kind_of(match), lambda kind: let(F.transform(units(match, kind), drawn), lambda parts: placed(kind, parts)))


def _found(text: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(PATTERN), 0)).otherwise(none)


def entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """(kind, norm, gender) of every distinct entity; the gender of a given name is what all its mentions agree on, else x."""
    matches = docs.select(F.explode(_found(F.col(text).cast("string"))).alias("match")).distinct()
    found = let(kind_of(F.col("match")), lambda kind: units(F.col("match"), kind))
    said = lambda g: F.coalesce(F.bool_or(F.col("u.gender") == g), F.lit(False))
    gender = F.when(said("m") & ~said("f"), "m").when(said("f") & ~said("m"), "f").otherwise("x")
    return matches.select(F.explode(found).alias("u")).groupBy("u.kind", "u.norm").agg(gender.alias("gender"))


def settled(found: DataFrame, key: str) -> DataFrame:
    """(kind, norm, gender, attempt, surrogate) without collisions.

    No two entities of a kind share a surrogate and no surrogate is an entity that occurs (surnames
    and given names, which share common words with the world, are only kept apart from each other, given names of
    all genders together). Of those that collide the one with the fewest attempts and the smallest form stays. Later
    attempts draw from ever more surrogates, so the rounds end.
    """
    of = [F.col(c) for c in ("kind", "norm", "gender", "attempt")]
    draw = lambda df: df.select(*of, surrogate(*of, key).alias("surrogate"))
    rows = common.written(draw(found.withColumn("attempt", F.lit(0))), "surrogates")
    real = rows.filter("kind NOT LIKE 'given%' AND kind NOT LIKE 'surname%'").select("kind", F.col("norm").alias("surrogate"), F.lit(True).alias("real"))
    while True:
        first = rows.groupBy("kind", "surrogate").agg(F.count("*").alias("n"), F.min(F.struct("attempt", "norm"))["norm"].alias("stays"))
        again = first.join(real, ["kind", "surrogate"], "left").filter("n > 1 OR real")
        again = common.written(again.select("kind", "surrogate", F.when(F.col("real").isNull(), F.col("stays")).alias("stays")), "collisions")
        if again.isEmpty():
            return rows
        moved = rows.join(again.withColumn("hit", F.lit(True)), ["kind", "surrogate"], "left")
        moves = F.col("hit").isNotNull() & ~F.col("norm").eqNullSafe(F.col("stays"))
        rows = common.written(draw(moved.select("kind", "norm", "gender", (F.col("attempt") + moves.cast("int")).alias("attempt"))), "surrogates")


def pseudonymised(docs: DataFrame, key: str, text: str = "text", count: str | None = None) -> DataFrame:
    """The rows of docs with surrogates in `text`; `count` names a column for the number of matches.

    Null texts stay null and have no matches, empty ones stay empty. Equal texts get equal results,
    whatever their ids; no column but the text is read, and all others are kept. An empty table
    gives an empty result.
    """
    names = set(docs.columns)
    free = lambda base: next(n for n in (base + "_" * k for k in range(1, len(names) + 2)) if n not in names)
    digest, drawn, matches = free("digest"), free("facts"), free("matches")
    chosen = settled(common.written(entities(docs, text), "entities"), key)
    # what the replacement of a match cannot know from the match alone
    unlisted = F.col("kind").startswith("given_") & (F.col("gender") != "x") & _listed(F.col("norm")).isNull()
    redrawn = common.written(chosen.filter((F.col("attempt") > 0) | unlisted).select("kind", "norm", "attempt", "gender"), "redrawn")
    body = F.col(text).cast("string")
    kind_of_map = "map<string,struct<attempt:int,gender:string>>"
    no_map = F.lit(None).cast(kind_of_map)
    if redrawn.isEmpty():
        rows = docs.withColumn(drawn, no_map)
    else:
        # facts are looked up for the texts that hold such an entity, and only these are joined
        held = docs.select(F.sha1(body.cast("binary")).alias(digest), F.explode(F.array_distinct(_found(body))).alias("match")).distinct()
        held = held.select(digest, F.explode(let(kind_of(F.col("match")), lambda kind: units(F.col("match"), kind))).alias("u")).select(digest, "u.kind", "u.norm").distinct()
        maps = held.join(redrawn, ["kind", "norm"]).groupBy(digest).agg(
            F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "norm"), F.struct("attempt", "gender")))).alias(drawn)
        )
        rows = docs.withColumn(digest, F.sha1(body.cast("binary"))).join(common.written(maps, "maps"), digest, "left").drop(digest)
    rows = rows.withColumn(matches, _found(body))
    given = F.coalesce(F.col(drawn), F.create_map().cast(kind_of_map))
    between = F.split(body, PATTERN, -1)
    woven = F.concat(
        F.element_at(between, 1),
        F.array_join(F.transform(F.col(matches), lambda m, i: F.concat(replaced(m, given, key), F.element_at(between, i + 2))), ""),
    )
    rows = rows.withColumn(text, F.when(F.size(matches) > 0, woven).otherwise(body))
    if count:
        rows = rows.withColumn(count, F.size(F.coalesce(F.col(matches), F.array().cast("array<string>"))).cast("long"))
    return rows.drop(drawn, matches)


#: Key of the registered queries; a deployment passes its own.
QUERY_KEY = "corpus-2024"


def op10_pii_surrogates(spark, sf_dir) -> DataFrame:
    """doc_id, n_found and the text with surrogates of every document."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymised(docs, QUERY_KEY, count="n_found").select("doc_id", "n_found", "text")
