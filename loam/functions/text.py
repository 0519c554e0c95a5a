"""Column functions on text, numbers, dates and file names. All but the three pandas UDFs are built-in expressions."""

from __future__ import annotations

import re
import unicodedata
from functools import cache, lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# A token of the ranking functions, a number in free text, a number that a claim can be checked by.
TOKEN = r"[\p{L}\p{N}_'-]+"
NUMBER = r"(?<![\p{L}\p{N}_.,/-])-?(?:[0-9]{1,3}(?:[.,][0-9]{3})+(?:[.,][0-9]+)?|[0-9]+(?:[.,][0-9]+)?)%?(?![\p{L}\p{N}_/-])"
CLAIM = r"(?<![0-9])[0-9]+(?:[.,][0-9]+)*(?:\s?[%％])?(?![0-9])"


@cache
def fold_table() -> tuple[str, str]:
    """Accented Latin letters (composed of one base letter and marks) and their bases, for translate()."""
    source, target = "đ", "d"
    for code in range(0x00E0, 0x1EFA):
        letter = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFD", letter) if unicodedata.category(c) != "Mn")
        if letter == letter.lower() and base != letter and len(base) == 1:
            source, target = source + letter, target + base
    return source, target


def fold(text: Column) -> Column:
    """Lower case without Latin and Vietnamese marks."""
    return F.translate(F.lower(F.coalesce(text, F.lit(""))), *fold_table())


def squeeze(text: Column) -> Column:
    """Folded, with runs of anything but letters and digits as one space."""
    return F.trim(F.regexp_replace(fold(text), "[^a-z0-9]+", " "))


_ASCII = r"^[\x00-\x7F]*$"
#: What Python's regular expressions and strip() take for white space.
_SPACES = r"[\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


@F.pandas_udf(StringType())
def _passage_key(text: pd.Series) -> pd.Series:
    other = re.compile(r"[\W_]+")
    return text.map(lambda t: None if t is None else other.sub(" ", unicodedata.normalize("NFKC", t).casefold()).strip())


def passage_key(text: Column) -> Column:
    """Text in its compatibility form, with case, punctuation and spacing folded away. ASCII texts are keyed by built-in
    expressions; composing marks and letters needs Unicode's tables, so other texts go through a batched function."""
    text = F.coalesce(text, F.lit(""))
    plain = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))
    return F.coalesce(_passage_key(F.when(~text.rlike(_ASCII), text)), plain)


@cache
def _entity_tables() -> tuple[str, str, str, str]:
    """How characters are keyed: (from, to) for translate(), what isn't answered by ``to`` being dropped; an expression of the
    characters that become several, and those as entries of str_to_map(). Hangul syllables, which go by a rule, aren't in."""
    singles, dropped, several = [], [], []
    for code in range(0x80, 0x110000):
        letter = chr(code)
        if 0xD800 <= code < 0xE000 or 0xAC00 <= code < 0xD7A4:
            continue
        key = "".join(c for c in unicodedata.normalize("NFKD", letter) if not unicodedata.combining(c)).casefold()
        if key != letter:
            (dropped if not key else singles if len(key) == 1 else several).append((letter, key))
    to_one = "".join(a for a, _ in singles + dropped), "".join(b for _, b in singles)
    ranges: list[list[int]] = []
    for letter, _ in several:
        if ranges and ranges[-1][1] == ord(letter) - 1:
            ranges[-1][1] += 1
        else:
            ranges.append([ord(letter), ord(letter)])
    own = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges)
    return *to_one, f"[{own}\\x{{AC00}}-\\x{{D7A3}}]", "\x02".join(f"{a}\x01{b}" for a, b in several)


def entity_key(name: Column) -> Column:
    """Name in its compatibility form without marks, with case and spacing folded away: every character by itself, as marks are
    what would be put in order or composed. Built-in expressions alone."""
    source, target, several, entries = _entity_tables()
    jamo = lambda first, n: "".join(chr(first + i) for i in range(n))
    pick = lambda of, i: F.substring(F.lit(of), i.cast("int") + 1, F.lit(1))

    def spelled(c: Column) -> Column:
        at = F.ascii(c) - 0xAC00
        hangul = F.concat(pick(jamo(0x1100, 19), F.floor(at / 588)), pick(jamo(0x1161, 21), F.floor(at / 28) % 21), F.when(at % 28 > 0, pick(jamo(0x11A7, 28), at % 28)).otherwise(""))
        known = F.coalesce(F.try_element_at(F.str_to_map(F.lit(entries), F.lit("\x02"), F.lit("\x01")), c), c)
        return F.when((at >= 0) & (at < 11172), hangul).otherwise(F.when(c.rlike(several), known).otherwise(c))

    text = F.coalesce(name, F.lit(""))
    whole = F.when(text.rlike(several), F.array_join(F.transform(F.split(text, ""), spelled), "")).otherwise(text)
    keyed = F.when(text.rlike(_ASCII), F.lower(text)).otherwise(F.translate(F.translate(whole, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), source, target))
    return F.regexp_replace(F.regexp_replace(keyed, _SPACES, " "), "^ | $", "")


@lru_cache(maxsize=1 << 16)
def _bare(name: str) -> str:
    bare = "".join([c for c in unicodedata.normalize("NFKD", name) if c < "\u0300" or not unicodedata.combining(c)])
    return " ".join(bare.casefold().split())


@F.pandas_udf(StringType())
def _entity_key(name: pd.Series) -> pd.Series:
    return pd.Series([None if one is None else _bare(one) for one in name], dtype=object)


#: The optimizer would otherwise ask for a key once in each filter and once more in the row.
_entity_key_once = _entity_key.asNondeterministic()


def entity_key_column(name: Column) -> Column:
    """As ``entity_key``, for a column of many rows: a batched function that remembers the names it keyed last, as the tables of the
    built-in form take several times as long. ASCII names are keyed by built-in expressions."""
    name = F.coalesce(name, F.lit(""))
    plain = F.regexp_replace(F.regexp_replace(F.lower(name), _SPACES, " "), "^ | $", "")
    return F.coalesce(_entity_key_once(F.when(~name.rlike(_ASCII), name)), plain)


def tokens(text: Column) -> Column:
    """Folded tokens in order, repeats included."""
    return F.regexp_extract_all(fold(text), F.lit(TOKEN), F.lit(0))


def clean(text: Column) -> Column:
    """Without NUL; runs of blanks one space, three and more line ends two; trimmed."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), "\x00", "")
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return F.regexp_replace(text, r"^\s+|\s+$", "")


# Role words at a group name's end, role phrases, and words that mean department.
ROLE_WORDS = ("members", "member", "owners", "owner", "visitors", "visitor", "thanh", "vien", "chu", "so", "huu", "khach")
ROLE_PHRASES = ("thanh vien", "chu so huu", "khach truy cap", "nguoi truy cap")
DEPARTMENT_WORDS = ("phong", "ban", "bo", "phan", "department", "dept", "team", "group", "nhom", "division")


def department_key(name: Column) -> Column:
    """A department's name without words that only say it is one."""
    return F.array_join(F.filter(F.split(squeeze(name), " "), lambda w: ~w.isin(*DEPARTMENT_WORDS)), " ")


def group_key(name: Column) -> Column:
    """A provider group's name as the department it stands for: role phrases and trailing role words go."""
    text = squeeze(name)
    for phrase in ROLE_PHRASES:
        text = F.replace(text, F.lit(phrase), F.lit(" "))
    text = F.trim(F.regexp_replace(text, " +", " "))
    text = F.regexp_replace(text, rf"(?:(?:^| )(?:{'|'.join(ROLE_WORDS)}))+$", "")
    return F.array_join(F.filter(F.split(text, " "), lambda w: ~w.isin(*DEPARTMENT_WORDS) & (w != "")), " ")


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def emails(email: Column, login: Column, principal_id: Column, name: Column) -> Column:
    """Distinct lower-case addresses of a principal, best source first; of a login only what follows the last bar."""
    of = lambda c: F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(EMAIL), F.lit(0))
    last = F.element_at(F.split(F.coalesce(login, F.lit("")), r"\|"), -1)
    return F.array_distinct(F.transform(F.concat(of(email), of(last), of(principal_id), of(name)), F.lower))


def parse_decimal(cell: Column) -> Column:
    """decimal(38,10) of an English or Vietnamese number; null for formulas and what is no finite number.

    What has no digit, and digits with at most commas before one dot, are read by one pattern; they are most cells of most tables.
    """
    raw = F.trim(F.coalesce(cell, F.lit("")))
    plain = raw.rlike(r"^-?[0-9]+(?:(?:,[0-9]+)*\.[0-9]+)?\z")
    return F.when(plain, F.replace(raw, F.lit(","), F.lit("")).try_cast("decimal(38,10)")).when(raw.rlike("[0-9]"), _any_decimal(raw))


def _any_decimal(raw: Column) -> Column:
    text = F.regexp_replace(raw, r"[\s%₫$€£]", "")
    dot, comma = F.length(F.regexp_extract(text, r"^(.*\.)", 1)), F.length(F.regexp_extract(text, r"^(.*,)", 1))
    both = F.when(comma > dot, F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(text, F.lit(","), F.lit("")))
    single = text.rlike(r"^[^,]*,[^,]*$") & ~text.rlike(r",.{3}$")
    plain = F.when(single, F.replace(text, F.lit(","), F.lit("."))).otherwise(F.replace(text, F.lit(","), F.lit("")))
    value = F.when((dot > 0) & (comma > 0), both).otherwise(plain)
    good = text.rlike(r"^-?[0-9][0-9.,]*$") & ~raw.rlike(r"^[=+@]")
    return F.when(good & value.rlike(r"^-?[0-9]+\.?[0-9]*$"), F.rtrim(F.regexp_replace(value, r"\.$", "")).try_cast("decimal(38,10)"))


def readings(token: Column) -> Column:
    """array<double> of every value a number's token could mean: decimal or grouped, a percent also as a share."""
    text = F.regexp_replace(token, "%$", "")
    as_double = lambda c: c.try_cast("double")
    strip = lambda c, s: F.replace(c, F.lit(s), F.lit(""))
    dots, commas = F.regexp_count(text, F.lit(r"\.")), F.regexp_count(text, F.lit(","))
    last_dot = F.length(F.regexp_extract(text, r"^(.*\.)", 1)) > F.length(F.regexp_extract(text, r"^(.*,)", 1))
    mixed = F.when(last_dot, strip(text, ",")).otherwise(F.replace(strip(text, "."), F.lit(","), F.lit(".")))
    point = F.when(dots + commas == 1, F.replace(text, F.lit(","), F.lit(".")))
    grouped = F.when(text.rlike(r"^-?[0-9]{1,3}([.,][0-9]{3})+$"), F.regexp_replace(text, "[.,]", ""))
    one = F.when((dots > 0) & (commas > 0), F.array(as_double(mixed))).when(dots + commas > 0, F.array(as_double(point), as_double(grouped))).otherwise(F.array(as_double(text)))
    values = F.array_compact(one)
    share = F.when(token.endswith("%"), F.concat(values, F.transform(values, lambda v: v / 100))).otherwise(values)
    return F.array_distinct(share)


# Parameter names of URLs that hold secrets.
SECRET_WHOLE = ("code", "sig", "signature", "token", "password", "passwd", "secret", "auth", "credential", "credentials", "jwt", "sas", "state", "assertion")
SECRET_LAST = ("token", "secret", "password", "passwd", "signature", "credential", "credentials", "sig", "jwt", "auth")
SECRET_KEYS = ("api", "access", "secret", "private", "client", "auth", "account", "signing", "encryption", "subscription")


def redact(text: Column) -> Column:
    """Values of secret query parameters and bearer tokens as ***; a name counts whole, by its last word, or as a key of
    a known kind; words part at - _ . and at capitals."""
    last, kinds, whole = "|".join(SECRET_LAST), "|".join(SECRET_KEYS), "|".join(SECRET_WHOLE)
    humps = "|".join(w.capitalize() for w in SECRET_LAST)
    part = r"[^=&?#\s]*"
    names = rf"(?i:{whole})|{part}[-_.](?i:{last})|{part}[a-z0-9](?:{humps})|(?:{part}[-_.])?(?i:{kinds})[-_.]?(?i:key)"
    text = F.regexp_replace(text, rf"([?&](?:{names})=)[^&#\s]+", "$1***")
    return F.regexp_replace(text, r"(?i)\b(bearer\s+)[A-Za-z0-9._~+/=-]{8,}", "$1***")


# Fixed value: what a citation marker may stand in.
BRACKET = r"\[([^\[\]]{1,240})\]"


def citation_numbers(text: Column) -> Column:
    """Sorted distinct numbers of citation markers ([C4: …], [C1, C2], legacy [n] of at most two digits)."""
    inner = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(BRACKET), F.lit(1))
    of = lambda s: F.regexp_extract_all(s, F.lit(r"(?i)(?<![\p{L}\p{N}_])C([0-9]{1,3})(?![\p{L}\p{N}_])"), F.lit(1))
    legacy = lambda s: F.regexp_extract_all(s, F.lit(r"(?i)^\s*(?:Source ID:\s*)?([0-9]{1,2})\s*$"), F.lit(1))
    found = F.flatten(F.transform(inner, lambda s: F.when(F.size(of(s)) > 0, of(s)).otherwise(legacy(s))))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: x.cast("int"))))


@F.pandas_udf(StringType())
def keep_known_markers(text: pd.Series, known: pd.Series) -> pd.Series:
    """Text without citation markers whose numbers aren't in ``known`` (array<int>); groups keep their known part."""
    bracket, marker, legacy = re.compile(BRACKET), re.compile(r"\bC(\d{1,3})\b", re.I), re.compile(r"\s*(?:Source ID:\s*)?([0-9]{1,2})\s*", re.I)

    def one(value: str, ids: set) -> str:
        def swap(m: re.Match) -> str:
            own = legacy.fullmatch(m[1])
            numbers = [int(x) for x in marker.findall(m[1]) or (own.groups() if own else ())]
            kept = [n for n in numbers if n in ids]
            if len(kept) == len(numbers):
                return m[0]
            return f"[{', '.join(f'C{n}' for n in kept)}]" if kept else ""

        return re.sub(r"[ \t]+([.,;:!?])", r"\1", re.sub(r"[ \t]{2,}", " ", bracket.sub(swap, value))).strip()

    return pd.Series([one(t or "", set() if k is None else set(k)) for t, k in zip(text, known, strict=True)])


def sentences(text: Column) -> Column:
    return F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"(?<=[.!?])\s+"), lambda s: s != "")


def has_claim(sentence: Column) -> Column:
    """Whether a sentence holds a number outside citation markers."""
    return F.regexp_replace(sentence, BRACKET, "").rlike(CLAIM)


# Formats by MIME type and by other spellings of an extension.
MIME_FORMATS = {
    "application/pdf": "pdf", "application/msword": "doc", "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "application/vnd.ms-excel": "xls", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx", "application/vnd.ms-powerpoint": "ppt",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "pptx", "text/csv": "csv", "text/plain": "txt", "text/markdown": "md", "text/html": "html",
}
FORMAT_ALIASES = {"jpeg": "jpg", "tiff": "tif", "htm": "html", "markdown": "md"}


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair)), key)


def file_format(filename: Column, mime: Column) -> Column:
    """Short format name, by extension or else by MIME type; empty if unknown."""
    extension = F.lower(F.regexp_extract(F.trim(F.coalesce(filename, F.lit(""))), r"\.([A-Za-z0-9]{1,5})$", 1))
    kind = F.lower(F.trim(F.split(F.coalesce(mime, F.lit("")), ";")[0]))
    return F.when(extension != "", F.coalesce(_lookup(FORMAT_ALIASES, extension), extension)).otherwise(F.coalesce(_lookup(MIME_FORMATS, kind), F.lit("")))


def period_start(question: Column, today: Column) -> Column:
    """First day of the period a folded question names ("this week", "last 7 days", ...); null if none."""
    days = F.regexp_extract(question, r"\b(?:last|past) (\d{1,3}) days\b", 1)
    days = F.when(days != "", days).otherwise(F.regexp_extract(question, r"\b(\d{1,3}) ngay (?:qua|gan day|truoc)\b", 1)).try_cast("int")
    start = F.when((days >= 1) & (days <= 3650), F.date_sub(today, days - 1))
    for pattern, unit in ((r"\b(hom nay|today)\b", "day"), (r"\b(tuan nay|this week)\b", "week"), (r"\b(thang nay|this month)\b", "month"), (r"\b(nam nay|this year)\b", "year")):
        start = F.coalesce(start, F.when(question.rlike(pattern), F.date_trunc(unit, today).cast("date")))
    return start


def iso_date(value: Column) -> Column:
    """Date of a text that starts YYYY-MM-DD; null otherwise."""
    head = F.substring(F.coalesce(value, F.lit("")), 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(head, "yyyy-MM-dd"))


def rollout_bucket(key: Column) -> Column:
    """Stable number from 0 to 99: the first four bytes of the key's sha256, modulo 100."""
    return (F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long") % 100).cast("int")


# Phrases that try to turn a model's instructions, and shapes of credentials.
INJECTION = r"(?i)(ignore (all |any )?(previous|prior|above) (instructions|prompts)|disregard (the )?(system|previous)|reveal (the |your )?(system )?prompt|you are now|developer mode|jailbreak)"
CREDENTIAL = r"(?i)(-----BEGIN [A-Z ]*PRIVATE KEY-----|\bAKIA[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{20,}|\bsk-[A-Za-z0-9]{20,}|(password|secret|api[_-]?key|token)\s*[:=]\s*\S{6,})"


def injection(text: Column) -> Column:
    return F.coalesce(text.rlike(INJECTION), F.lit(False))


def leaks_credential(text: Column) -> Column:
    return F.coalesce(text.rlike(CREDENTIAL), F.lit(False))


FOLLOW_UP = r"\b(it|its|they|them|this|that|these|those|he|she|no|do|nay|kia|ay)\b|\b(what about|how about|and the|the same|con|the con|vay con|tiep theo)\b"


def is_follow_up(question: Column) -> Column:
    """At most 16 words and a word that points back."""
    folded = fold(question)
    return (F.size(F.split(F.trim(folded), r"\s+")) <= 16) & folded.rlike(FOLLOW_UP)


def without_markers(text: Column) -> Column:
    """Text without citation markers and the gaps they leave."""
    text = F.regexp_replace(F.regexp_replace(text, r"\s*\[(?:C?[0-9]{1,3})(?:[:,][^\[\]]*)?\]", ""), r"[ \t]{2,}", " ")
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def compress(text: Column, most: int = 4000) -> Column:
    """Cut to ``most`` characters at the last line or sentence end past the half, with an ellipsis."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    head = F.substring(text, 1, most)
    # place of the last line end, or of the last dot before a space, from 0; -1 if none
    line = F.length(F.regexp_extract(head, r"(?s)^(.*\n)", 1)) - 1
    stop = F.when(head.rlike(r"\. "), F.length(F.regexp_extract(head, r"(?s)^(.*)\. ", 1))).otherwise(-1)
    last = F.greatest(line, stop)
    end = F.when(last > most // 2, last + 1).otherwise(most)
    return F.when(F.char_length(text) <= most, text).otherwise(F.concat(F.regexp_replace(F.substring(head, F.lit(1), end.cast("int")), r"\s+$", ""), F.lit(" …")))
