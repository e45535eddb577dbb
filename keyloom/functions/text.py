"""Scalar text functions as Column expressions: JVM-side, inside code generation where Spark has it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The keys of the US and Russian layouts, pair by pair, unshifted letters and signs, then shifted signs.
US_KEYS = "qwertyuiop[]asdfghjkl;'zxcvbnm,./?@#$^&`"
RU_KEYS = 'йцукенгшщзхъфывапролджэячсмитьбю.,"№;:?ё'
US_SHIFTED, RU_SHIFTED = '{}:"<>~', "ХЪЖЭБЮЁ"
# The rows of Russian letters by which keyboard neighbours are told.
RU_ROWS = ("йцукенгшщзхъ", "фывапролджэ", "ячсмитьбю")
EN_VOWELS, RU_VOWELS = "aeiou", "аеёиоуыэюя"

_letters = [(u, r) for u, r in zip(US_KEYS, RU_KEYS) if u.isalpha()]
US = US_KEYS + "".join(u.upper() for u, _ in _letters) + US_SHIFTED
RU = RU_KEYS + "".join(r.upper() for _, r in _letters) + RU_SHIFTED

WORD_MIN, WORD_MAX = 2, 24


def to_russian(c: Column) -> Column:
    """Every key's Russian character; others pass."""
    return F.translate(c, US, RU)


def to_english(c: Column) -> Column:
    return F.translate(c, RU, US)


def count_of(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def has_cyrillic(c: Column) -> Column:
    return c.rlike("[а-яА-ЯёЁ]")


def has_latin(c: Column) -> Column:
    return c.rlike("[A-Za-z]")


def direction(c: Column) -> Column:
    """ru2us if Cyrillic letters outnumber Latin ones, else us2ru."""
    return F.when(count_of(c, "[а-яА-ЯёЁ]") > count_of(c, "[A-Za-z]"), "ru2us").otherwise("us2ru")


def project(c: Column) -> Column:
    """The text on the other layout, by its own direction."""
    return F.when(direction(c) == "ru2us", to_english(c)).otherwise(to_russian(c))


def without_whitespace(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", "")


def edge_whitespace(c: Column) -> Column:
    """struct(lead, core, trail)."""
    part = lambda k: F.regexp_extract(c, r"(?sU)^(\s*)(.*?)(\s*)$", k)
    return F.struct(part(1).alias("lead"), part(2).alias("core"), part(3).alias("trail"))


def edge_punctuation(c: Column) -> Column:
    """struct(lead, core, trail): what lies outside the outermost letters and digits."""
    part = lambda k: F.regexp_extract(c, r"(?s)^([^\p{L}\p{N}]*)(.*?)([^\p{L}\p{N}]*)$", k)
    return F.struct(part(1).alias("lead"), part(2).alias("core"), part(3).alias("trail"))


def segments(c: Column) -> Column:
    """array of struct(text, is_ws): alternating runs."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"((?U)\s+|\S+)"), F.lit(1)), lambda s: F.struct(s.alias("text"), s.rlike(r"^(?U)\s").alias("is_ws")))


def words(c: Column) -> Column:
    """Lower-cased tokens of letters and hyphens, of 2 to 24 characters."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}-]+"), lambda w: F.length(w).between(WORD_MIN, WORD_MAX))


def normalized_words(c: Column) -> Column:
    """White-space tokens, lower-cased, without edge punctuation, non-empty."""
    bare = F.transform(F.split(F.lower(c), r"\s+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    return F.filter(bare, lambda w: w != "")


def last_word(c: Column) -> Column:
    return F.get(F.reverse(normalized_words(c)), F.lit(0))


def replace_last_word(c: Column, replacement: Column) -> Column:
    """The last word exchanged; what stands around it stays."""
    found = r"(?s)^(.*?)([\p{L}\p{N}](?:[^\s]*[\p{L}\p{N}])?)([^\p{L}\p{N}]*)$"
    return F.when(c.rlike(found), F.concat(F.regexp_extract(c, found, 1), replacement, F.regexp_extract(c, found, 3)))


def word_case(original: Column, replacement: Column) -> Column:
    """The replacement with the original's casing: all capitals, a first capital, or as it is."""
    first = F.substring(original, 1, 1)
    capital = F.concat(F.upper(F.substring(replacement, 1, 1)), F.substr(replacement, F.lit(2)))
    return F.when(~original.rlike(r"[\p{L}&&[^\p{Lu}]]"), F.upper(replacement)).when(first.rlike(r"\p{Lu}"), capital).otherwise(replacement)


def script(c: Column) -> Column:
    cyr, lat, dig = has_cyrillic(c), has_latin(c), c.rlike("[0-9]")
    other = c.rlike(r"[^а-яА-ЯёЁA-Za-z0-9\-_./\\:@'+#]")
    kinds = cyr.cast("int") + lat.cast("int") + dig.cast("int")
    return F.when(c == "", "empty").when(other | (kinds == 0), "other").when(kinds > 1, "mixed").when(cyr, "cyrillic").when(lat, "ascii").otherwise("numeric")


def is_cli_option(c: Column) -> Column:
    return c.rlike(r"^--?[A-Za-z0-9_=./:,\-]*[A-Za-z][A-Za-z0-9_=./:,\-]*$")


def is_ascii(c: Column) -> Column:
    return ~c.rlike(r"[^\x00-\x7F]")


def ascii_letters(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z]", "")


def is_acronym(c: Column) -> Column:
    """Two to four ASCII letters, all capitals."""
    return ascii_letters(c).rlike("^[A-Z]{2,4}$")


def is_brand(c: Column) -> Column:
    """Four ASCII letters or more, with a small one and a capital after the first."""
    return ascii_letters(c).rlike("^(?=.{4,})(?=.*[a-z]).+[A-Z]")


def has_domain_dot(c: Column) -> Column:
    return c.rlike(r"[A-Za-z][^A-Za-z]*[A-Za-z].*\.[A-Za-z]{2,4}$")


def is_technical(c: Column) -> Column:
    structured = has_domain_dot(c) | c.rlike(r"[A-Za-z0-9][-_][A-Za-z0-9]") | c.rlike(r"[/\\@+#]") | is_acronym(c) | is_brand(c)
    return c.contains("://") | c.contains("@") | c.rlike("[0-9]") | (is_ascii(c) & has_latin(c) & structured)


def kind(c: Column) -> Column:
    s = script(c)
    return F.when(c == "", "empty").when(is_cli_option(c), "cli_option").when(is_technical(c), "technical").when(s == "mixed", "mixed_script").when(s == "numeric", "number").when(s.isin("cyrillic", "ascii"), "plain_word").otherwise("other")


def language_of(known_ru: Column, known_en: Column, script_: Column) -> Column:
    return F.when(known_ru & known_en, "ambiguous").when(known_ru, "russian").when(known_en, "english").when(script_ == "cyrillic", "russian").when(script_ == "ascii", "english").otherwise("unknown")


def plausible(word: Column, vowels: str = EN_VOWELS, per_vowel: int = 5) -> Column:
    """Short words; others with a vowel in so many letters, and no four consonants on end."""
    v = f"[{vowels}{vowels.upper()}]"
    needed = F.greatest(F.ceil(F.length(word) / per_vowel), F.lit(1))
    return (F.length(word) <= 2) | ((count_of(word, v) >= needed) & ~word.rlike(rf"(?:(?!{v})\p{{L}}){{4}}"))


def plausibility(c: Column, vowels: str = EN_VOWELS, per_vowel: int = 5) -> Column:
    """Share of plausible words; 1 where there is none."""
    found = F.filter(F.split(c, r"[^\p{L}]+"), lambda w: w != "")
    return F.when(F.size(found) == 0, F.lit(1.0)).otherwise(F.size(F.filter(found, lambda w: plausible(w, vowels, per_vowel))) / F.size(found))


def trigrams(word: Column) -> Column:
    """Sliding three-character windows of the word between `^^` and `$`."""
    padded = F.concat(F.lit("^^"), word, F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substr(padded, i, F.lit(3)))


def chars(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def one_deletions(word: Column) -> Column:
    """The word itself and every word with one character less, each once."""
    cut = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1)))
    return F.array_distinct(F.concat(F.array(word), cut))


def adjacent_swaps(word: Column) -> Column:
    """Every word with two neighbouring, different characters exchanged."""
    at = F.when(F.length(word) >= 2, F.sequence(F.lit(1), F.length(word) - 1)).otherwise(F.array().cast("array<int>"))
    swapped = F.transform(at, lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1, F.lit(1)), F.substr(word, i, F.lit(1)), F.substr(word, i + 2)))
    return F.array_distinct(F.filter(swapped, lambda w: w != word))


def repeated_run_deletions(word: Column) -> Column:
    """Every word with one character less where two equal ones stand together."""
    at = F.when(F.length(word) >= 2, F.sequence(F.lit(1), F.length(word) - 1)).otherwise(F.array().cast("array<int>"))
    at = F.filter(at, lambda i: F.substr(word, i, F.lit(1)) == F.substr(word, i + 1, F.lit(1)))
    return F.array_distinct(F.transform(at, lambda i: F.concat(F.substr(word, F.lit(1), i), F.substr(word, i + 2))))


def insertions(word: Column, alphabet: str) -> Column:
    """Every word with one letter of the alphabet more."""
    at = F.sequence(F.lit(0), F.length(word))
    rows = F.transform(at, lambda i: F.transform(F.array(*map(F.lit, alphabet)), lambda a: F.concat(F.substr(word, F.lit(1), i), a, F.substr(word, i + 1))))
    return F.array_distinct(F.flatten(rows))


def substitutions(word: Column, classes: dict[str, str]) -> Column:
    """Every word with one character exchanged for another of its class: {character: others}."""
    table = F.create_map(*[x for k, v in classes.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    at = F.sequence(F.lit(1), F.length(word))
    other = lambda i: F.coalesce(F.try_element_at(table, F.substr(word, i, F.lit(1))), F.array().cast("array<string>"))
    rows = F.transform(at, lambda i: F.transform(other(i), lambda a: F.concat(F.substr(word, F.lit(1), i - 1), a, F.substr(word, i + 1))))
    return F.array_distinct(F.flatten(rows))


def keyboard_neighbours(rows: tuple[str, ...] = RU_ROWS) -> dict[str, str]:
    """Characters beside each other in a row."""
    return {c: row[max(0, i - 1) : i] + row[i + 1 : i + 2] for row in rows for i, c in enumerate(row)}


def splits(word: Column) -> Column:
    """array of struct(left, right): all ways to cut the word in two."""
    at = F.when(F.length(word) >= 2, F.sequence(F.lit(1), F.length(word) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(F.substr(word, F.lit(1), i).alias("left"), F.substr(word, i + 1).alias("right")))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix: the first place where the characters differ."""
    same = F.transform(F.arrays_zip(chars(a).alias("x"), chars(b).alias("y")), lambda p: p["x"].eqNullSafe(p["y"]))
    first = F.array_position(same, F.lit(False))
    return F.when(first == 0, F.length(a)).otherwise((first - 1).cast("int"))


def is_adjacent_transposition(a: Column, b: Column) -> Column:
    """Equal but for one exchange of neighbours."""
    return (F.length(a) == F.length(b)) & (a != b) & F.array_contains(adjacent_swaps(a), b)


def changed_words(a: Column, b: Column) -> Column:
    """Number of words that differ by position; the longer count if the numbers of words differ."""
    x, y = normalized_words(a), normalized_words(b)
    differ = F.size(F.filter(F.arrays_zip(x.alias("x"), y.alias("y")), lambda p: ~p["x"].eqNullSafe(p["y"])))
    return F.when(F.size(x) != F.size(y), F.greatest(F.size(x), F.size(y))).otherwise(differ)


def boundary_split(a: Column, b: Column) -> Column:
    """Whether b is a with its last word cut in two."""
    x, y = normalized_words(a), normalized_words(b)
    n = F.size(x)
    same = F.slice(x, F.lit(1), F.greatest(n - 1, F.lit(0))) == F.slice(y, F.lit(1), F.greatest(n - 1, F.lit(0)))
    return (n > 0) & (F.size(y) == n + 1) & same & (F.get(x, n - 1) == F.concat(F.get(y, n - 1), F.get(y, n)))


def to_milli(c: Column) -> Column:
    """Thousandths as smallint, rounded half away from zero, clamped."""
    return F.least(F.greatest(F.round(c * 1000), F.lit(-32768.0)), F.lit(32767.0)).cast("smallint")


def bucket(c: Column, edges: list[int]) -> Column:
    """Label of the first edge not below the value."""
    return reduce(lambda acc, e: acc.when(c <= e, f"le{e}"), edges[1:], F.when(c <= edges[0], f"le{edges[0]}")).otherwise(f"gt{edges[-1]}")


def depth_bucket(c: Column) -> Column:
    return F.when(c <= 2, "0-2").when(c == 3, "3").when(c <= 7, "4-7").otherwise("8+")


def common_affix_edit(a: Column, b: Column) -> Column:
    """struct(move_left, backspaces, insert): what turns a into b at the end of a line, common ends untouched."""
    lead = common_prefix(a, b)
    tail = F.least(common_prefix(F.reverse(a), F.reverse(b)), F.least(F.length(a), F.length(b)) - lead)
    return F.struct(tail.alias("move_left"), (F.length(a) - lead - tail).alias("backspaces"), F.substr(b, lead + 1, F.length(b) - lead - tail).alias("insert"))


def has_repeated_run(c: Column, n: int) -> Column:
    return c.rlike(rf"(\p{{L}})\1{{{n - 1}}}")


def alpha_share(c: Column) -> Column:
    return F.when(F.length(c) > 0, count_of(c, r"\p{L}") / F.length(c)).otherwise(0.0)
