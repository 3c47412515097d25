"""Dates, hashes, names and identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.text import norm

# Month names in dates.
MONTHS = ("января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря")
# Letters and their transcription.
LETTERS = {"а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "h", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya"}
# Legal forms that a company name may begin with.
LEGAL_FORMS = ("ооо", "зао", "ао", "пао", "оао", "нко", "ип", "гк", "нп", "акционерное общество", "общество с ограниченной ответственностью", "открытое акционерное общество", "индивидуальный предприниматель")
# Words that a company name may end with.
BUZZWORDS = ("ии", "ай", "ai", "llc", "inc", "group", "групп")
# Weights of the check digits of taxpayer numbers.
INN_WEIGHTS = (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)


def parsed_date(text: Column) -> Column:
    """ISO dates, ``D.M.YYYY`` and ``D month YYYY``; null for anything else."""
    t = F.btrim(text)
    out = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(t, "yyyy-MM-dd")).when(t.rlike(r"^\d{8}$"), F.try_to_date(t, "yyyyMMdd"))
    out = out.when(t.rlike(r"^\d{1,2}\.\d{1,2}\.\d{4}$"), F.try_to_date(t, "d.M.yyyy"))
    for i, month in enumerate(MONTHS, 1):
        named = F.regexp_extract(F.lower(t), rf"^(\d{{1,2}})\s+{month}\s+(\d{{4}})$", 1)
        year = F.regexp_extract(F.lower(t), rf"^(\d{{1,2}})\s+{month}\s+(\d{{4}})$", 2)
        out = out.when(named != "", F.try_to_date(F.concat_ws("-", year, F.lit(str(i)), named), "yyyy-M-d"))
    return out


def deadline(day: Column, priority: Column) -> Column:
    """Two days for p1, a week for p2, none for the others."""
    return F.when(priority == "p1", F.date_add(day, 2)).when(priority == "p2", F.date_add(day, 7))


def dedup_key(*parts: Column, title: Column, at: int = 1) -> Column:
    """SHA-256 of the parts joined by bars, the normalised title at its place; null counts as empty."""
    values = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    values.insert(at, norm(title))
    return F.sha2(F.concat_ws("|", *values), 256)


def canonical_items(items: Column) -> Column:
    """Items (JSON text of a list of objects) as canonical JSON: keys sorted at every depth, and without ``extra.file_path``, which
    differs from fetch to fetch. Variant values keep the keys of an object sorted. Null where the text isn't such a list."""
    found = F.try_variant_get(F.try_parse_json(items), "$", "array<map<string,variant>>")

    def cleaned(item: Column) -> Column:
        extra = F.try_variant_get(item["extra"], "$", "map<string,variant>")
        kept = F.to_variant_object(F.map_filter(extra, lambda k, _: k != "file_path"))
        without = F.map_concat(F.map_filter(item, lambda k, _: k != "extra"), F.create_map(F.lit("extra"), kept))
        return F.to_variant_object(F.when(extra.isNull(), item).otherwise(without))

    return F.to_json(F.to_variant_object(F.transform(found, cleaned)))


def content_hash(items: Column) -> Column:
    """MD5 of a snapshot's items, a column of structs: the same whatever the order of their keys and the place of their page."""
    return json_hash(F.to_json(items))


def json_hash(items: Column) -> Column:
    """``content_hash`` of items that are JSON text."""
    return F.md5(F.coalesce(canonical_items(items), F.lit("")).cast("binary"))


def stable_page_hash(page: Column) -> Column:
    """A digest of a page that ignores what changes between fetches: nonces, tokens and timestamps in attributes."""
    for attribute in ("nonce", "data-token", "data-timestamp"):
        page = F.regexp_replace(page, rf'{attribute}="[^"]*"', "")
    return F.sha2(page, 256)


def transliterated(text: Column) -> Column:
    """Cyrillic in Latin letters; the empty text where there is none."""
    single = {k: v for k, v in LETTERS.items() if len(v) == 1}
    plain, latin = "".join(single), "".join(single.values())
    out = F.translate(F.regexp_replace(text, "[ъьЪЬ]", ""), plain + plain.upper(), latin + latin.upper())
    for letter, several in LETTERS.items():
        if len(several) > 1:
            out = F.regexp_replace(F.regexp_replace(out, letter, several), letter.upper(), several.upper())
    return F.when(text.rlike("[а-яёА-ЯЁ]"), out).otherwise("")


def without_legal_form(name: Column) -> Column:
    """The name without the first legal form that it begins with, if anything is left."""
    rest = F.btrim(F.regexp_extract(name, rf"(?iu)^(?:{'|'.join(LEGAL_FORMS)})(.*)$", 1), F.lit(" .\"'-"))
    return F.when(rest != "", rest).otherwise(name)


def without_buzzwords(name: Column) -> Column:
    return F.btrim(F.regexp_replace(name, rf"(?iu)(\s+({'|'.join(BUZZWORDS)}))+$", ""))


def name_variants(name: Column, number: Column) -> Column:
    """Search terms for a company, each once: the name, without legal form, without buzzwords, transcribed, its number."""
    # Each step is bound once, as the element of an array, so that it isn't computed again in the steps after it.
    step = lambda x, use: F.transform(F.array(x), use)[0]
    terms = step(without_legal_form(name), lambda bare: step(without_buzzwords(bare), lambda short: F.array(name, bare, short, transliterated(short), number)))
    return F.array_distinct(F.filter(terms, lambda t: F.btrim(t) != ""))


def inn_valid(inn: Column) -> Column:
    """Whether a taxpayer number of 10 or 12 digits has the right check digits."""

    def check(n: int) -> Column:
        total = F.lit(0)
        for i, w in enumerate(INN_WEIGHTS[len(INN_WEIGHTS) - n :]):
            total = total + F.substring(inn, i + 1, 1).cast("int") * w
        return total % 11 % 10 == F.substring(inn, n + 1, 1).cast("int")

    return F.when(inn.rlike(r"^\d{10}$"), check(9)).when(inn.rlike(r"^\d{12}$"), check(10) & check(11)).otherwise(False)


def digest(text: Column) -> Column:
    return F.left(F.md5(text.cast("binary")), F.lit(12))


def file_name(text: Column) -> Column:
    return F.left(F.regexp_replace(text, r"[^\p{L}\p{N}]", "_"), F.lit(50))
