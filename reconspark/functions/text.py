"""Normalisers and parsers of recognised text, as column expressions.

Regular expressions use ``(?U)`` where white space and letters beyond ASCII count. Nulls: a function returns null where
there is nothing to read, unless it says otherwise. Compatibility normalisation (NFKC) has no built-in and is an Arrow UDF.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Look-alike folds, patterns of document codes, sentinels and kinds.
DIGIT_FOLDS = [("З", "3"), ("О", "0"), ("O", "0"), ("Л", "1"), ("L", "1"), ("I", "1"), ("Н", "11"), ("Б", "6"), ("Ч", "4")]
PREFIX = "[0-9ОOILЛЗ]{3}-[0-9ОOILЛЗ]{2}-[0-9ОOILЛЗ]{4}"
LETTERS = "0-9ЗОOLIЛНБ"
ILO = "И[.]?[ЛJI1Ј][ОO0]"
SENTINELS = "(?iu)^(?:Без\\s*шифра|Не\\s*определено|Не\\s*распознано)$"
EXTENSIONS = "(?i)\\.(?:PDF|DOCX?|XLSX?|DWG|ZIP)$"
KEYWORDS = "ПРОЕКТ|ГЛАВНЫЙ|КНИГА|ТОМ|ДОКУМЕНТ|ОПИСЬ|ИНЖЕНЕР|КОНТРОЛЬ|ЛИСТ|СИСТЕМА|ЗАМЕСТИТЕЛЬ"
LATIN_HEX = ("СВАЕ", "CBAE")
DATE_FORMATS = ["dd.MM.yyyy", "d.M.yyyy", "dd.MM.yy", "yyyy-MM-dd", "dd/MM/yyyy", "dd.MM.yyyy HH:mm", "yyyy-MM-dd'T'HH:mm:ss"]
TIME_FORMATS = ["H:mm", "HH:mm", "H:mm:ss", "HH:mm:ss"]
FIRST_SERIAL, END_SERIAL = 36526, 109575
ALPHABET = "0-9A-Za-zА-Яа-яЁё"
#: What fold reads as a hyphen; text without one holds no code of the two families.
HYPHEN = "[-–—]"
#: Ordered: the first whose parts are all contained wins.
ORGANIZATIONS = [
    ("Трансэлектропроект", ["ТРАНСЭЛЕКТРОПРОЕКТ"]),
    ("Гипротранссвязь", ["ГИПРОТРАНССВЯЗЬ"]),
    ("Ленгипротранс", ["ЛЕНГИПРОТР"]),
    ("Росжелдорпроект", ["РОСЖЕЛДОР"]),
    ("Росжелдорпроект", ["ГИПР", "ТРАНСПУТ"]),
    ("Желдорпроект", ["ЖЕЛДОРПРОЕКТ"]),
]
UNKNOWN = "Не определено"
FIELD_LABELS = {"CRC": "CRC32", "Page": "Лист", "Pages": "Листов", "Revision": "Номер изменения"}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _or_empty(x: Column | str) -> Column:
    return F.coalesce(_c(x), F.lit(""))


def _found(x: Column, pattern: str, group: int = 0) -> Column:
    return F.nullif(F.regexp_extract(x, pattern, group), F.lit(""))


def let(x: Column, use) -> Column:
    """use(x) with x evaluated once, however often use names it."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def squeeze(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, "(?U)\\s+", " "))


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def fold(x: Column | str) -> Column:
    """Upper case, Ё as Е, dashes as hyphens, white space squeezed; null as empty."""
    return squeeze(F.translate(F.upper(_or_empty(x)), "Ё–—", "Е--"))


def fold_form(x: Column | str) -> Column:
    """As fold, but dashes stay."""
    return squeeze(F.translate(F.upper(_or_empty(x)), "Ё", "Е"))


def compact(x: Column | str) -> Column:
    s = F.regexp_replace(fold(x), "(?U)\\s+", "")
    return F.replace(F.replace(s, F.lit("ИЛ0"), F.lit("ИЛО")), F.lit("ИЛO"), F.lit("ИЛО"))


def book_clean(x: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(fold(x), "^КНИГА\\s*\\d+[.,]?\\s*", ""), "[^А-ЯA-Z0-9]", "")


def _digits(x: Column) -> Column:
    return reduce(lambda s, p: F.replace(s, F.lit(p[0]), F.lit(p[1])), DIGIT_FOLDS, x)


def digits(x: Column | str) -> Column:
    """Letters that OCR reads for digits as those digits; Н stands for two ones."""
    return _digits(fold(x))


def code_text(x: Column | str) -> Column:
    c = let(compact(x), lambda c: F.aggregate(F.regexp_extract_all(c, F.lit(f"({PREFIX})"), F.lit(1)), c, lambda s, m: F.replace(s, m, _digits(m))))
    c = F.regexp_replace(c, "[ТT][КK][РP]", "ТКР")
    return F.regexp_replace(c, "(ТКР[0-9ЗОOLIЛНБ]{1,2})Л\\.", "$1.1.")


def legacy_code(x: Column | str) -> Column:
    """The canonical code of one of the two project families, or null."""
    c = F.regexp_replace(code_text(x), f"({ILO}[34ЗЧ])Л\\.", "$1.1.")
    c = F.regexp_replace(c, f"({ILO}[34ЗЧ]\\.[0-9]{{1,2}})Л(?=[^0-9]|$)", "$1.1")
    ilo = f"(\\d{{3}}-\\d{{2}}-\\d{{4}})-{ILO}([34ЗЧ]\\.[{LETTERS}]{{1,2}}\\.[{LETTERS}]{{1,2}})(?![{LETTERS}])"
    tkr = f"(\\d{{3}}-\\d{{2}}-\\d{{4}})-ТКР([{LETTERS}]{{1,2}}(?:[.,][{LETTERS}]{{1,3}}){{0,3}})(?![{LETTERS}])"

    def read(c: Column) -> Column:
        one = F.concat(F.regexp_extract(c, ilo, 1), F.lit("-ИЛО"), _digits(F.regexp_extract(c, ilo, 2)))
        two = F.concat(F.regexp_extract(c, tkr, 1), F.lit("-ТКР"), F.replace(_digits(F.regexp_extract(c, tkr, 2)), F.lit(","), F.lit(".")))
        return F.when(c.rlike(ilo), one).when(c.rlike(tkr), two)

    return let(c, read)


def find_code(x: Column | str) -> Column:
    """Of several lines: the first line with a code, then two lines the first of which ends with a hyphen, then all."""
    s = _or_empty(x)
    one = lambda v: F.when(v.rlike(HYPHEN), F.when(v.contains("\n"), _first_code(v)).otherwise(legacy_code(v)))
    return let(s, one)


def _first_code(s: Column) -> Column:
    return let(F.filter(F.split(s, "[\\r\\n]"), lambda v: v != ""), lambda lines: _first_of(s, lines))


def _first_of(s: Column, lines: Column) -> Column:
    nearby = F.transform(lines, lambda v, i: F.when(F.rtrim(v).endswith("-"), F.concat(v, F.get(lines, i + 1))))
    # Lines, then pairs of lines, then all: the first that holds a code.
    tries = F.array_compact(F.concat(lines, nearby, F.array(s)))
    return F.get(F.filter(F.transform(F.filter(tries, lambda v: v.rlike(HYPHEN)), legacy_code), lambda v: v.isNotNull()), F.lit(0))


def value(x: Column | str) -> Column:
    """NFKC, hyphens, squeezed, without quotes around it, upper case; null if empty, overlong or a sentinel."""
    s = F.btrim(squeeze(F.translate(nfkc(_or_empty(x)), "–—", "--")), F.lit(' "«»'))
    return let(s, _unless_sentinel)


def _unless_sentinel(s: Column) -> Column:
    return F.when((F.length(s) > 0) & (F.length(s) <= 4096) & ~s.rlike(SENTINELS), F.upper(s))


def key(x: Column | str) -> Column:
    """value without white space; null as empty."""
    return F.coalesce(F.regexp_replace(value(x), "(?U)\\s+", ""), F.lit(""))


def code_value(x: Column | str) -> Column:
    shaped = lambda v: code_text(v).rlike(f"^\\d{{3}}-\\d{{2}}-\\d{{4}}-(?:{ILO}|ТКР)[0-9ЗЧОOLIЛНБ.,]+(?:-УЛ)?$")
    return let(value(x), lambda v: F.when(shaped(v), F.coalesce(legacy_code(v), v)).otherwise(v))


def document_code(x: Column | str) -> Column:
    s = _or_empty(x)
    return F.when(s.contains("\n"), F.coalesce(find_code(s), code_value(s))).when(s.rlike(EXTENSIONS), F.coalesce(find_code(s), value(s))).otherwise(code_value(s))


def page_code(x: Column | str) -> Column:
    """An explicit code of the second family; else one made of a project number and a volume number; else find_code."""
    found, prefix = find_code(x), _found(compact(x), "\\d{3}-\\d{2}-\\d{4}")
    volume = _found(fold(x), f"(?U)\\bТОМ\\s*(4\\s*\\.\\s*[34ЗЧ]\\s*\\.\\s*[{LETTERS}]{{1,2}}\\s*\\.\\s*[{LETTERS}]{{1,2}})(?![{LETTERS}])", 1)
    made = F.concat(prefix, F.lit("-ИЛО"), F.substring(F.regexp_replace(_digits(volume), "\\s+", ""), 3, 1000))
    return let(found, lambda v: F.when(v.contains("-ТКР"), v).otherwise(F.coalesce(made, v)))


def tom(code: Column | str) -> Column:
    """The volume a code stands for."""
    c = _c(code)
    return F.when(c.contains("ТКР"), F.concat(F.lit("3."), F.substring_index(c, "ТКР", -1))).when(c.contains("ИЛО"), F.concat(F.lit("4."), F.substring_index(c, "ИЛО", -1)))


def registry_text(x: Column | str) -> Column:
    return F.trim(_or_empty(x))


def registry_normal(x: Column | str) -> Column:
    return F.upper(F.regexp_replace(nfkc(registry_text(x)), "(?U)\\s+", " "))


def serial_of(day: Column | str) -> Column:
    """Spreadsheet serial of a date (1900 system)."""
    return F.datediff(_c(day), F.lit("1899-12-30").cast("date"))


def date_of(serial: Column | str) -> Column:
    return F.date_add(F.lit("1899-12-30").cast("date"), _c(serial).cast("int"))


def date_serial(x: Column | str, number: bool = False) -> Column:
    """The serial of a date cell: of years 2000 to 2199, from a number or from text in one of the formats."""
    s = F.trim(_c(x).cast("string"))
    n = F.floor(F.replace(s, F.lit(","), F.lit(".")).try_cast("double")).cast("int")
    as_number = F.when((n >= FIRST_SERIAL) & (n < END_SERIAL), n)
    if number:
        return as_number
    day = F.coalesce(*(F.to_date(F.try_to_timestamp(s, F.lit(f))) for f in DATE_FORMATS), F.when(s.rlike("^\\d{4}-\\d{2}-\\d{2}"), F.to_date(F.try_to_timestamp(s))))
    return F.when(day.isNotNull(), F.when((F.year(day) >= 2000) & (F.year(day) < 2200), serial_of(day))).otherwise(as_number)


def time_key(x: Column | str) -> Column:
    """HH:mm:ss of a fraction of a day or of a time in text; else the normalised text."""
    s = registry_text(x)
    n = s.try_cast("double")
    part = F.floor(n * 86400 + 0.5).cast("long")
    fraction = F.format_string("%02d:%02d:%02d", (part / 3600).cast("int"), ((part % 3600) / 60).cast("int"), (part % 60).cast("int"))
    clock = F.coalesce(*(F.date_format(F.try_to_timestamp(s, F.lit(f)), "HH:mm:ss") for f in TIME_FORMATS))
    return F.when((n >= 0) & (n < 1), fraction).otherwise(F.coalesce(clock, registry_normal(s)))


def registry_key(name: Column | str, extension: Column | str, checksum: Column | str, day: Column | str, time: Column | str) -> Column:
    n, e = registry_normal(name), registry_normal(extension)
    stem = F.when((e != "") & n.endswith(F.concat(F.lit("."), e)), F.substring(n, F.lit(1), F.length(n) - F.length(e) - 1)).otherwise(n)
    return F.concat_ws("\u001f", stem, e, registry_normal(checksum), F.coalesce(date_serial(day).cast("string"), registry_normal(day)), time_key(time))


def pad8(x: Column) -> Column:
    """Zeros on the left up to eight characters; longer text is kept."""
    return F.when(F.length(x) < 8, F.lpad(x, 8, "0")).otherwise(x)


def crc(x: Column | str) -> Column:
    """A labelled checksum of 7 or 8 hexadecimal digits, else a bare one of 8, after look-alikes are folded."""
    t = F.translate(fold_form(x), "СВАЕОOILЗ", "CBAE00113")
    labelled = _found(t, "(?:CRC\\s*32[^0-9A-F]{0,8})([0-9A-F]{7,8})(?![A-Z0-9])", 1)
    return F.coalesce(pad8(labelled), _found(t, "(?<![A-Z0-9])([0-9A-F]{8})(?![A-Z0-9])", 1))


def page_crc(x: Column | str) -> Column:
    """The checksum of a page: a labelled one of 8 digits; where the label is in Latin letters, what crc reads."""
    found = lambda n: _digits(_found(F.translate(n, "СРВАЕ", "CRBAE"), "CRC\\s*32[^0-9A-F]{0,6}([0-9A-FОOIL]{8})(?![0-9A-FОOIL])", 1))
    return let(fold(x), lambda n: F.when(n.rlike("CRC\\s*32"), crc(x)).otherwise(found(n)))


def page_number(x: Column | str) -> Column:
    s = F.translate(F.upper(_or_empty(x)), "ЗОOI|", "30011")
    s = F.btrim(F.regexp_replace(s, "Л[ИП]СТ(?:ОВ)?|PAGE", ""), F.lit(" .:;\n\r"))
    n = F.when(s.rlike("^[0-9]{1,4}$"), s.try_cast("int"))
    return F.when(n.between(1, 1000), n)


def organization(x: Column | str) -> Column:
    test = lambda letters, parts: reduce(lambda a, b: a & b, (letters.contains(p) for p in parts))
    return let(F.regexp_replace(fold_form(x), "[^А-Я]", ""), lambda v: F.coalesce(*(F.when(test(v, parts), F.lit(n)) for n, parts in ORGANIZATIONS), F.lit(UNKNOWN)))


SECTION = (
    "(?iuU)(?<![А-Яа-я])(Подраздел|Раздел|Часть)\\s*(\\d+)\\s*[.,:]?\\s*([\\s\\S]*?)"
    "(?=(?:Подраздел|Раздел|[Ч\\[:]асть|[К\\[:]нига)\\b|[Т•]ом\\s*\\d|\\b\\d{3}-\\d{2}-\\d{4}\\b|CRC32|Алгоритм|Наименование файла|Главный|Заместитель|$)"
)


def sections(x: Column | str) -> Column:
    """Heading type -> "number. name"; of several of one type the last counts."""
    t = F.regexp_replace(_or_empty(x), "-\\s*\\r?\\n(?=[а-я])", "")
    kinds, numbers, names = (F.regexp_extract_all(t, F.lit(SECTION), F.lit(i)) for i in (1, 2, 3))
    rows = F.transform(F.arrays_zip(kinds.alias("k"), numbers.alias("n"), names.alias("v")), lambda r: F.struct(fold_form(r["k"]).alias("key"), F.concat(r["n"], F.lit(". "), F.btrim(squeeze(r["v"]), F.lit(" ."))).alias("value")))
    last = lambda rows: F.filter(rows, lambda r, i: ~F.exists(F.slice(rows, i + 2, F.size(rows) + 1), lambda s: s["key"] == r["key"]))
    return F.map_from_entries(let(rows, last))


def merge_sections(old: Column | str, new: Column | str) -> Column:
    """A new section replaces an old one unless it is shorter than 85 % of it."""
    return F.map_zip_with(_c(old), _c(new), lambda _, a, b: F.when(a.isNull() | (F.length(b) >= F.length(a) * 0.85), b).otherwise(a))


def documentation_kind(x: Column | str) -> Column:
    """The one kind of documentation that an inventory's head names, else null."""
    head = lambda t, end: F.when(end > 0, F.substring(t, F.lit(1), end - 1)).otherwise(F.substring(t, 1, 1200))
    staged = lambda t, at: F.when(at > 0, F.substring(t, at, F.length(t))).otherwise(t)
    return let(let(let(fold(x), lambda t: head(t, F.call_function("instr", t, F.lit("ШИФР ТОМА")))), lambda t: staged(t, F.call_function("instr", t, F.lit("СТАДИЯ")))), _lone_kind)


def _lone_kind(t: Column) -> Column:
    kinds = F.array_compact(F.array(
        F.when(t.rlike("ПРОЕКТН(?:АЯ|ОЙ)\\s+(?:И\\s+СМЕТН(?:АЯ|ОЙ)\\s+)?ДОКУМЕНТАЦИ"), F.lit("ПД")),
        F.when(t.rlike("ИНЖЕНЕРН.{0,12}ИЗЫСКАН"), F.lit("ИИ")),
        F.when(t.rlike("ДОКУМЕНТАЦИ.{0,12}ПО\\s+ПЛАНИРОВКЕ\\s+ТЕРРИТОРИИ"), F.lit("ДПТ")),
    ))
    return let(kinds, lambda k: F.when(F.size(k) == 1, k[0]))


def book_text(x: Column | str, is_iul: Column) -> Column:
    name = _found(_or_empty(x), "(?iu)Книга\\s*\\d+[.,]?\\s*([\\s\\S]*?)(?=\\r?\\n\\s*(?:\\d{3}\\s*[-–—]|Том\\s*\\d|Главный\\s|Заместител)|$(?![\\s\\S]))", 1)
    cut = F.get(F.split(name, "(?iuU)\\b(?:Том|CRC32|Наименование файла|Алгоритм)\\b"), F.lit(0))
    return F.btrim(squeeze(F.when(is_iul, cut).otherwise(name)), F.lit(" ."))


def book_number(x: Column | str) -> Column:
    return _found(_or_empty(x), "(?iuU)\\bКнига\\s+(\\d{1,3})(?!\\d)", 1).try_cast("int")


def score(x: Column | str) -> Column:
    """How much a recognised page reads like a document."""
    return F.regexp_count(fold(x), F.lit(KEYWORDS)) * 25 + F.regexp_count(_or_empty(x), F.lit("[А-Яа-я]{4,}")) + F.when(find_code(x).isNotNull(), 120).otherwise(0)


def clear_orientation(x: Column | str) -> Column:
    return (F.regexp_count(_or_empty(x), F.lit("[А-Яа-яЁё]{4,}")) >= 15) & (score(x) >= 300)


def different(a: Column | str, b: Column | str, share: float = 0.28) -> Column:
    """Whether two names differ by more than a share of edits; short or missing names never do."""
    far = lambda p: (F.least(F.length(p["x"]), F.length(p["y"])) >= 4) & (F.levenshtein(p["x"], p["y"]) / F.greatest(F.length(p["x"]), F.length(p["y"])) > share)
    return F.coalesce(let(F.struct(book_clean(a).alias("x"), book_clean(b).alias("y")), far), F.lit(False))


def valid_surname(x: Column | str) -> Column:
    return F.trim(_or_empty(x)).rlike("^\\p{L}[\\p{L} '\\-]{0,79}$")


def fragment(x: Column | str) -> Column:
    n = _found(registry_normal(x), "ФРАГМЕНТ\\s*([0-9]{1,3})(?![0-9])", 1)
    return F.coalesce(n.try_cast("int").cast("string"), F.lit(""))


def is_base_volume(name: Column | str, code: Column | str) -> Column:
    """Whether a registry file is the volume itself and not something attached to it."""
    n = F.regexp_replace(F.regexp_replace(registry_normal(name), "(?U)\\s+", ""), EXTENSIONS, "")
    k = key(code)
    at = F.call_function("locate", k, n)
    tail = F.substring(n, at + F.length(k), F.length(n))
    attached = tail.rlike("^(?:\\.[А-ЯA-Z0-9]|-[А-ЯA-Z0-9])") & ~tail.rlike("^-ИЗМ[.0-9(]")
    return (at == 0) | ~attached


def append_lines(old: Column | str, new: Column | str) -> Column:
    """New lines that old does not have yet, each once, after the old text, which is kept as it is."""
    had = F.filter(F.split(_or_empty(old), "\\r?\\n"), lambda v: v != "")
    more = F.array_except(F.filter(F.split(_or_empty(new), "\\r?\\n"), lambda v: v != ""), had)
    return F.concat_ws("\n", F.nullif(_or_empty(old), F.lit("")), F.nullif(F.array_join(more, "\n"), F.lit("")))


def field_label(x: Column | str) -> Column:
    return F.coalesce(*(F.when(_c(x) == k, F.lit(v)) for k, v in FIELD_LABELS.items()), _c(x))


def inventory_suffix(x: Column | str) -> Column:
    c = code_text(x)
    return F.when(c.rlike(f"^(?:{ILO}|ТКР)"), F.substring(find_code(F.concat(F.lit("000-00-0000-"), c)), 13, 1000))


def lone_key_pattern(k: Column) -> Column:
    """A pattern that finds a key as a whole, with white space anywhere between its signs."""
    quoted = F.transform(F.split(k, ""), lambda c: F.when(c.rlike("[\\p{L}\\p{N}]"), c).otherwise(F.concat(F.lit("\\"), c)))
    return F.concat(F.lit("(?U)(?<![\\p{L}\\p{N}])"), F.array_join(F.filter(quoted, lambda c: F.length(c) > 0), "\\s*"), F.lit("(?![\\p{L}\\p{N}.])"))


def html_escape(x: Column | str) -> Column:
    """Text as it may stand in HTML; null as empty."""
    return reduce(lambda s, p: F.replace(s, F.lit(p[0]), F.lit(p[1])), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")], _or_empty(x))
