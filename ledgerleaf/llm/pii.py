"""Personal data replaced by format-preserving pseudonyms, with built-in functions only.

A value that passes its check (Luhn digit, IBAN's check digits, octets, calendar date) is
permuted with a key within its own format by a Feistel network: the value's positions, each with
its radix, stand in two halves, and each round adds digits drawn from a keyed digest of one half
to the other half, position by position. The permutation depends on the key and the kind only, so
a value has the same pseudonym in every document, different values have different ones, and with
the key every step can be undone.

Separators of telephone, card, social security and account numbers have no part in the permutation
and are set again after it, so a number has one pseudonym in all its notations. Of a telephone
number the last ten digits change: that is all but the country code of +1 and of others with ten
digits behind theirs; the notations with and without it are linked. Dates are linked over their
notations too, and IPv6 addresses, which come out in full. Letter case, check digits' validity and
other signs stay; only octets and groups of an address change their number of digits.

Kinds: e-mail addresses (all but the last label), telephone numbers, IPv4 and IPv6 addresses,
payment card numbers, IBANs, US social security numbers, dates from 1900-01-01 on for 72,900 days
in three notations, access keys and bearer tokens, and values given to a password, token or secret.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
FIRST_DAY = "1900-01-01"
# Days that have pseudonyms: two positions of this radix.
DAY_RADIX = 270
# Positions that one digest serves; in longer halves they repeat.
DRAWN = 16
# Digits of a telephone number that change, from its end.
NATIONAL = 10

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_SECRET_NAME = r"(?i:password|passwd|secret|token|api_?key) ?[=:] ?[\x22\x27]?"
# Up to the closing quote or white space; signs at the end that close a sentence stay outside.
_SECRET = (
    r"(?i:password|passwd|secret|token|api_?key) ?[=:] ?"
    r"(?:\x22[^\x22\s]{6,}+|\x27[^\x27\s]{6,}+|(?![\x22\x27])(?=[^\s\x22\x27]{6})[^\s\x22\x27]*[A-Za-z0-9_+/=-])"
)
# What access keys begin with.
_KEY_PREFIX = "AKIA|ASIA|gh[a-z]_|github_pat_|sk-|xox[a-z]-|(?i:bearer) "
_GROUP = "[0-9a-fA-F]{1,4}"
# Kinds that begin with a letter at the begin of a word, or anywhere with a digit or sign.
WORDS = {
    "email": r"[\p{L}\p{N}._%+-]{1,64}+@(?:[\p{L}\p{N}-]{1,63}[.]){1,8}\p{L}{2,24}(?![\p{L}\p{N}-])",
    "secret": _SECRET,
    "iban": "[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "key": "(?:(?:AKIA|ASIA)[A-Z0-9]{16}|(?:gh[a-z]_|github_pat_|sk-|xox[a-z]-)[A-Za-z0-9_-]{16,}"
    "|(?i:bearer) [A-Za-z0-9._~+/-]{15,}[A-Za-z0-9_=])(?![A-Za-z0-9])",
    "ip6": f"(?:(?:{_GROUP}:){{7}}{_GROUP}|(?:{_GROUP}:){{2,6}}:(?:{_GROUP}(?::{_GROUP}){{0,4}})?"
    f"|{_GROUP}::{_GROUP}(?::{_GROUP}){{1,5}})(?![0-9A-Za-z:.])",
}
NUMBERS = {
    "phone": "(?<![0-9+])(?:[+][0-9]{1,3}[ .-]?)?[(][0-9]{2,4}[)][ .-]?[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])"
    "|(?<![0-9+])[+][0-9]{1,3}(?:[ .-][0-9]{2,4}){2,4}(?![0-9])"
    "|(?<![0-9+.-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9-])"
    "|(?<![0-9+])[+][1-9][0-9]{7,14}(?![0-9])"
    "|(?<![0-9+.,-])[0-9]{3}[.][0-9]{3}[.][0-9]{4}(?![0-9]|[.,-][0-9])"
    "|(?<![0-9+.,-])(?<![0-9] )[0-9]{3} [0-9]{3} [0-9]{4}(?! ?[0-9]|[.,-][0-9])",
    "ip": f"(?<![0-9.])(?:{_OCTET}[.]){{3}}{_OCTET}(?![0-9]|[.][0-9])",
    "date": "(?<![0-9.-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])"
    "|(?<![0-9./])[0-9]{2}[.][0-9]{2}[.][0-9]{4}(?![0-9]|[.][0-9])"
    "|(?<![0-9./])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![0-9/])",
    "ssn": "(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": "(?<![0-9])[0-9]{4}(?:(?: [0-9]{4}){3}|(?:-[0-9]{4}){3})(?![0-9])"
    "|(?<![0-9])[0-9]{4}(?: [0-9]{6} [0-9]{5}|-[0-9]{6}-[0-9]{5})(?![0-9])|(?<![0-9])[0-9]{13,19}(?![0-9])",
}
PATTERN = (
    f"(?<![A-Za-z0-9._%+-])(?:{'|'.join(WORDS.values())})|(?=[0-9(+])(?:{'|'.join(NUMBERS.values())})"
)
# Texts without any of these have no match.
_SIGNS = "[0-9@=:]|(?i:bearer) |gh[a-z]_|github_pat_|sk-|xox[a-z]-|AKIA|ASIA"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, use: str) -> str:
    """``use`` with ``name`` for a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {use}), 1)"


def feistel(numbers: str, radices: str, kind: str, key: str) -> str:
    """SQL that permutes an array of ints, each below its radix, among all such arrays.

    All arguments but the key are SQL; the arrays are of the same size.
    """

    def moved(own: str, limits: str, other: str) -> str:
        seed = f"concat({_quoted(key + '|')}, {kind}, '|', i, '|', array_join(cast({other} AS array<string>), ','))"
        drawn = f"cast(conv(substr(digest, pmod(j, {DRAWN}) * 4 + 1, 4), 16, 10) AS int)"
        steps = f"transform({own}, (x, j) -> x + {drawn})"
        return _let("digest", f"sha2({seed}, 256)", f"zip_with({steps}, {limits}, (x, r) -> pmod(x, r))")

    half, rest = f"size({numbers}) div 2", f"size({numbers}) - size({numbers}) div 2"
    cut = lambda x: (f"slice({x}, 1, cast({half} AS int))", f"slice({x}, cast({half} AS int) + 1, cast({rest} AS int))")
    (a, b), (a_limits, b_limits) = cut(numbers), cut(radices)
    return (
        f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('a', {a}, 'b', {b}), (s, i) -> if(i % 2 = 0,"
        f" named_struct('a', s.a, 'b', {moved('s.b', b_limits, 's.a')}),"
        f" named_struct('a', {moved('s.a', a_limits, 's.b')}, 'b', s.b)), s -> concat(s.a, s.b))"
    )


def _chars(text: str) -> str:
    return f"if(length({text}) > 0, transform(sequence(1, length({text})), k -> substr({text}, k, 1)), array())"


def luhn_digit(payload: str) -> str:
    """SQL for the check digit of the digits of a text."""
    digits = f"filter(cast(split(reverse({payload}), '') AS array<string>), c -> c >= '0' AND c <= '9')"
    doubled = f"transform({digits}, (c, i) -> cast(c AS int) * if(i % 2 = 0, 2, 1))"
    return f"cast(pmod(-aggregate({doubled}, 0, (t, x) -> t + x - if(x > 9, 9, 0)), 10) AS string)"


def iban_remainder(text: str) -> str:
    """SQL for the remainder by 97 of a text's digits, with letters as 10 to 35."""
    step = "if(c BETWEEN '0' AND '9', (a * 10 + cast(c AS int)) % 97, (a * 100 + ascii(c) - 55) % 97)"
    return f"aggregate({_chars(text)}, 0, (a, c) -> {step})"


def _filled(template: str, signs: str) -> str:
    """SQL for a template whose letters and digits are replaced, in order, by those of a text."""
    step = (
        f"if(rlike(c, '[0-9A-Za-z]'), named_struct('o', concat(s.o, substr({signs}, s.k + 1, 1)), 'k', s.k + 1),"
        " named_struct('o', concat(s.o, c), 'k', s.k))"
    )
    return f"aggregate({_chars(template)}, named_struct('o', '', 'k', 0), (s, c) -> {step}, s -> s.o)"


def _parts(v: str) -> str:
    """SQL for a struct of a value: its kind, what stays before, what changes, what stays after.

    Of kinds with separators the tail is the whole value, to be filled with the other two.
    An invalid value has no kind and nothing to change.
    """

    def split(kind: str, head: str, body: str, tail: str = "''") -> str:
        return f"named_struct('kind', {kind}, 'head', {head}, 'body', {body}, 'tail', {tail})"

    def after(kind: str, pattern: str, hexadecimal: bool = False) -> str:
        head = f"regexp_extract({v}, {_quoted('^(?:' + pattern + ')')}, 0)"
        body = f"substr({v}, length(h) + 1)"
        named = f"if(rlike({body}, '^[0-9a-f]+$'), 'hex', '{kind}')" if hexadecimal else f"'{kind}'"
        return _let("h", head, split(named, "h", body))

    top = _let("e", f"length(regexp_extract({v}, '[.]\\\\p{{L}}+$', 0))", split(
        "'email'", "''", f"substr({v}, 1, length({v}) - e)", f"right({v}, e)"))
    day = f"datediff(coalesce(try_to_date({v}, 'yyyy-MM-dd'), try_to_date({v}, 'dd.MM.yyyy'), try_to_date({v}, 'MM/dd/yyyy'), try_to_date({v}, 'dd/MM/yyyy')), date'{FIRST_DAY}')"
    stays = split("''", v, "''")
    digits = f"regexp_replace({v}, '[^0-9]', '')"
    phone = _let("d", digits, split(
        "'phone'", f"left(d, greatest(length(d) - {NATIONAL}, 0))", f"right(d, {NATIONAL})", v))
    iban = _let("d", f"replace({v}, ' ')", f"""if(length(d) BETWEEN 15 AND 34
        AND {iban_remainder("concat(substr(d, 5), left(d, 4))")} = 1,
        {split("'iban'", "left(d, 2)", "substr(d, 5)", v)}, {stays})""")
    card = _let("d", digits, f"""if({luhn_digit("left(d, length(d) - 1)")} = right(d, 1),
        {split("'card'", "''", "left(d, length(d) - 1)", v)}, {stays})""")
    return f"""CASE
      WHEN rlike({v}, {_quoted('^' + _SECRET_NAME)}) THEN {after('secret', _SECRET_NAME, True)}
      WHEN contains({v}, '@') THEN {top}
      WHEN rlike({v}, {_quoted('^(?:' + _KEY_PREFIX + ')')}) THEN {after('key', _KEY_PREFIX)}
      WHEN rlike({v}, '^[A-Z]{{2}}[0-9]{{2}} ?[A-Z0-9]{{4}}') THEN {iban}
      WHEN contains({v}, ':') THEN {split("'ip6'", "''", v)}
      WHEN rlike({v}, '^[+(]') OR rlike({v}, '^[0-9]{{3}}([-. ])[0-9]{{3}}[-. ][0-9]{{4}}$') THEN {phone}
      WHEN rlike({v}, '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$') THEN {split("'ssn'", "''", digits, v)}
      WHEN rlike({v}, '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$') THEN {split("'ip'", "''", v)}
      WHEN rlike({v}, '^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{2}}([./])[0-9]{{2}}[./][0-9]{{4}})$') THEN
        if(coalesce({day} BETWEEN 0 AND {DAY_RADIX**2 - 1}, false),
          {split("'date'", "''", f"cast({day} AS string)", v)}, {stays})
      ELSE {card} END"""


_LOWER, _UPPER, _HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
# Letters of Western Europe beyond ASCII, in both cases; other letters stay.
_LOWER_MORE = "".join(chr(c) for c in range(0xE0, 0xFF) if c != 0xF7)
_UPPER_MORE = "".join(chr(c) for c in range(0xC0, 0xDF) if c != 0xD7)


def pseudonym(value: str, key: str) -> str:
    """SQL for the pseudonym of a value that matches ``PATTERN``; an invalid one stays."""
    # The alphabet of each character that changes, empty for the others.
    alphabet = (
        f"CASE WHEN p.kind = 'hex' THEN if(instr('{_HEX}', c) > 0, '{_HEX}', '') WHEN c BETWEEN '0' AND '9' THEN '0123456789'"
        f" WHEN instr('{_LOWER}', c) > 0 THEN '{_LOWER}' WHEN instr('{_UPPER}', c) > 0 THEN '{_UPPER}'"
        f" WHEN instr('{_LOWER_MORE}', c) > 0 THEN '{_LOWER_MORE}' WHEN instr('{_UPPER_MORE}', c) > 0 THEN '{_UPPER_MORE}'"
        " ELSE '' END"
    )
    groups = "filter(split({}, ':'), x -> x <> '')"
    left_, right_ = (groups.format(f"split_part(p.body, '::', {k})") for k in (1, 2))
    zeros = f"array_repeat('0', 8 - size({left_}) - size({right_}))"
    # Eight groups, of which :: leaves out those that are zero.
    full = f"if(contains(p.body, '::'), concat({left_}, {zeros}, {right_}), split(p.body, ':'))"
    slots = f"""CASE p.kind
      WHEN 'ip6' THEN transform({full}, x -> named_struct('c', '', 'set', '', 'n', cast(conv(x, 16, 10) AS int), 'r', 65536))
      WHEN 'ip' THEN transform(split(p.body, '[.]'), x -> named_struct('c', '', 'set', '', 'n', cast(x AS int), 'r', 256))
      WHEN 'date' THEN transform(array(cast(p.body AS int) div {DAY_RADIX}, cast(p.body AS int) % {DAY_RADIX}),
        x -> named_struct('c', '', 'set', '', 'n', cast(x AS int), 'r', {DAY_RADIX}))
      ELSE transform(transform({_chars('p.body')}, c -> named_struct('c', c, 'set', {alphabet})),
        x -> named_struct('c', x.c, 'set', x.set, 'n', greatest(instr(x.set, x.c) - 1, 0), 'r', greatest(length(x.set), 1))) END"""
    date = f"""date_format(date_add(date'{FIRST_DAY}', cast(n[0] * {DAY_RADIX} + n[1] AS int)), CASE
        WHEN contains(p.tail, '-') THEN 'yyyy-MM-dd' WHEN contains(p.tail, '.') THEN 'dd.MM.yyyy'
        WHEN try_to_date(p.tail, 'MM/dd/yyyy') IS NOT NULL THEN 'MM/dd/yyyy' ELSE 'dd/MM/yyyy' END)"""
    spelled = "array_join(zip_with(q, n, (x, y) -> if(x.set = '', x.c, substr(x.set, y + 1, 1))), '')"
    remainder = iban_remainder("concat(w, p.head, '00')")
    check = f"lpad(cast(98 - {remainder} AS string), 2, '0')"
    shown = f"""CASE p.kind WHEN 'ip' THEN array_join(cast(n AS array<string>), '.') WHEN 'date' THEN {date}
      WHEN 'ip6' THEN array_join(transform(n, x -> lower(hex(x))), ':')
      WHEN 'card' THEN {_let('w', spelled, _filled("p.tail", f"concat(w, {luhn_digit('w')})"))}
      WHEN 'iban' THEN {_let('w', spelled, _filled("p.tail", f"concat(p.head, {check}, w)"))}
      WHEN 'phone' THEN {_let('w', f"concat(p.head, {spelled})", _filled("p.tail", "w"))}
      WHEN 'ssn' THEN {_let('w', spelled, _filled("p.tail", "w"))}
      ELSE concat(p.head, {spelled}, p.tail) END"""
    moved = feistel("transform(q, x -> x.n)", "transform(q, x -> x.r)", "p.kind", key)
    changed = _let("q", slots, _let("n", moved, shown))
    return _let("p", _parts(value), f"if(p.kind = '', p.head, {changed})")


def pseudonymise(column: str, key: str) -> Column:
    """The texts of a column with a pseudonym for each value; null stays null."""
    text, pattern = f"`{column}`", _quoted(PATTERN)
    found = f"transform(regexp_extract_all({text}, {pattern}, 0), v -> {pseudonym('v', key)})"
    joined = f"array_join(zip_with(split({text}, {pattern}, -1), concat({found}, array('')), (a, b) -> concat(a, b)), '')"
    return F.expr(f"if(rlike({text}, '{_SIGNS}') AND rlike({text}, {pattern}), {joined}, {text})")


def protect(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with its text pseudonymised and every other column as it is.

    A narrow plan: no shuffle, no Python. Null and empty texts stay as they are.
    """
    return docs.withColumn("text", pseudonymise("text", key))


# A key for the queries over test tables. Real data needs a secret one.
SAMPLE_KEY = "not-a-secret"


def op4_pii(docs: DataFrame) -> DataFrame:
    """Per row: doc_id and the text with pseudonyms."""
    return protect(docs.select("doc_id", "text"), SAMPLE_KEY)
