"""Format-preserving pseudonyms for personal data and secrets, by DataFrame functions only.

Validated numbers and dates are permuted by a keyed Feistel network within their format: card numbers keep length,
separators, the two digits of their issuer and a right check digit; phone numbers keep country code and separators, and
North American area and exchange codes stay valid where they are and invalid where they are not (any three digits count
as one); account numbers (IBAN) keep country, letters and right check digits;
social-security numbers stay valid ones; IPv4 addresses stay addresses; dates stay dates between 1900 and 2099 in the
notation they had. The permutation depends on the key and the value alone, so equal values stay linked across documents
and different values of a kind never meet; a value out of range after a round is walked on along its cycle. E-mail
addresses, access keys, passwords and long hexadecimal tokens, which have no number format, get keyed digests of the
same shape, whatever their length; a quoted value may hold blanks and ends with its line. After "secret:" or "token:" a
bare value counts only if it holds a digit or a sign, as prose has words there. What looks like a kind but fails its
validation (check digit, issuer, octets, calendar) is left as it is.

Each text is searched once by one pattern; the gaps between the matches are kept as they are and joined with the
pseudonyms again. Defined results: null texts stay null and empty ones empty; repeated rows are treated alike; an empty
table gives no rows; all other columns are kept. The key is a parameter; the default is for tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget_parser, free_name

KEY = "change-this-key"
ROUNDS = 8
WALK = 24
#: For phone numbers with an invalid code, a bit over a third of all: 0.64 ** 128 are not through.
WALK_PHONE = 128
_START, _END = "(?<![0-9A-Za-z])", "(?![0-9A-Za-z])"
_VALUE = "(?:\"[^\"\\r\\n]{6,}+\"|'[^'\"\\r\\n]{6,}+'[^\\s\"]*+|\"?[^\\s\"]{6,}+)"
#: Kind, pattern: the first that matches at a place takes it. Runs without an upper bound are possessive: no text is slow.
KINDS = (
    ("credential", f"(?i:(?:password|passwd|pwd|api[_-]?key)[ \\t]{{0,3}}[=:]|(?:secret|token)[ \\t]{{0,3}}(?:=|:(?=[ \\t]{{0,3}}(?:[\"']|[A-Za-z]*+[^\\sA-Za-z.,;:!?)]))))[ \\t]{{0,3}}{_VALUE}"),
    ("access_key", f"{_START}(?:AKIA|ASIA)[0-9A-Z]{{16}}{_END}"),
    ("hex_token", f"{_START}(?=[0-9]*+[A-Fa-f])[0-9A-Fa-f]{{32,}}+{_END}"),
    ("email", "(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++"),
    ("iban", f"{_START}[A-Z]{{2}}[0-9]{{2}}(?:[A-Z0-9]{{11,30}}+|(?: [A-Z0-9]{{4}}){{2,7}}+(?: [A-Z0-9]{{1,3}})?){_END}"),
    ("date", f"{_START}(?:(?:19|20)[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{2}}/[0-9]{{2}}/(?:19|20)[0-9]{{2}}){_END}"),
    ("ipv4", "(?<![0-9A-Za-z.])[0-9]{1,3}(?:\\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\\.[0-9])"),
    ("ssn", f"{_START}(?<!-)[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?!-){_END}"),
    ("phone", f"(?<![0-9A-Za-z+])(?:\\+?1[ .-]?)?(?:\\([0-9]{{3}}\\)[ .-]?|[0-9]{{3}}[ .-])[0-9]{{3}}[ .-][0-9]{{4}}{_END}"),
    ("world_phone", f"(?<![0-9A-Za-z+])\\+[1-9](?:[ .-]?\\(?[0-9]\\)?){{7,14}}+{_END}"),
    ("card", f"{_START}(?:[0-9]{{4}}(?: [0-9]{{4}}){{3}}|[0-9]{{4}}(?:-[0-9]{{4}}){{3}}|[0-9]{{4}}[ -][0-9]{{6}}[ -][0-9]{{5}}|[0-9]{{13,19}}){_END}"),
)
# Country codes of telephone numbers with one or two digits (all others have three); first digits of cards.
COUNTRY_CODES = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}"
ISSUERS = "2[2-7]|3[0-9]|4[0-9]|5[0-9]|6[0-9]"
PATTERN = "|".join(p for _, p in KINDS)


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _feistel(a: str, b: str, mod_a: str, mod_b: str, tweak: str, key: str) -> str:
    """Struct (a, b) of longs after the rounds: a permutation of pairs below mod_a and mod_b (ROUNDS is even)."""
    f = f"cast(conv(substr(sha2(concat({_text(key)}, ':{tweak}:', cast(i as string), ':', cast(s.b as string)), 256), 1, 14), 16, 10) as bigint)"
    return f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('a', cast({a} as bigint), 'b', cast({b} as bigint)), (s, i) -> named_struct('a', s.b, 'b', (s.a + {f}) % if(i % 2 = 0, cast({mod_a} as bigint), cast({mod_b} as bigint))))"


def _walked(start: str, step: str, valid: str, walk: int = WALK) -> str:
    """``step`` (of x.v) at least once and on until ``valid`` (of x.v)."""
    return f"aggregate(sequence(1, {walk}), named_struct('v', {start}, 'done', false), (x, j) -> if(x.done, x, named_struct('v', {step}, 'done', false)), x -> x.v)".replace("named_struct('v', " + step + ", 'done', false)", f"transform(array({step}), v -> named_struct('v', v, 'done', {valid}))[0]")


def _digits_permuted(digits: str, n: int, tweak: str, key: str) -> str:
    """A permutation of strings of ``n`` digits."""
    u, v = n // 2, n - n // 2
    s = _feistel(f"substr({digits}, 1, {u})", f"substr({digits}, {u + 1}, {v})", str(10**u), str(10**v), tweak, key)
    return f"transform(array({s}), r -> concat(lpad(cast(r.a as string), {u}, '0'), lpad(cast(r.b as string), {v}, '0')))[0]"


def _any_digits_permuted(digits: str, tweak: str, key: str) -> str:
    """A permutation of the strings of as many digits as ``digits`` has (2 to 30), of its own for each number of them."""
    half, rest = "(length(y) div 2)", "(length(y) - length(y) div 2)"
    s = _feistel(f"substr(y, 1, {half})", f"substr(y, {half} + 1)", f"pow(10, {half})", f"pow(10, {rest})", f"{tweak}', cast(length(y) as string), '", key)
    return f"transform(array({digits}), y -> transform(array({s}), r -> concat(lpad(cast(r.a as string), {half}, '0'), lpad(cast(r.b as string), {rest}, '0')))[0])[0]"


def _refill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced one after another."""
    return f"aggregate(split({shape}, ''), named_struct('o', '', 'k', 1), (z, c) -> if(c rlike '^[0-9]$', named_struct('o', concat(z.o, substr({digits}, z.k, 1)), 'k', z.k + 1), named_struct('o', concat(z.o, c), 'k', z.k)), z -> z.o)"


def _luhn(digits: str) -> str:
    """The Luhn sum modulo 10; the last digit counts once."""
    d = f"cast(substr({digits}, length({digits}) - p, 1) as int)"
    return f"(aggregate(sequence(0, length({digits}) - 1), 0, (t, p) -> t + if(p % 2 = 0, {d}, if({d} > 4, 2 * {d} - 9, 2 * {d}))) % 10)"


def _card(m: str, key: str) -> str:
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    body = f"transform(array({digits}), d -> concat(left(d, 2), {_any_digits_permuted('substr(d, 3, length(d) - 3)', 'card', key)}))[0]"
    full = f"transform(array({body}), q -> concat(q, cast((10 - {_luhn('concat(q, chr(48))')}) % 10 as string)))[0]"
    return f"if({_luhn(f'{digits}')} = 0 and {digits} rlike '^(?:{ISSUERS})', {_refill(m, full)}, {m})"


def _mod97(value: str) -> str:
    """``value`` modulo 97, with letters as the numbers from 10."""
    return f"aggregate(split({value}, ''), 0, (t, c) -> if(c rlike '^[A-Z]$', t * 100 + ascii(c) - 55, t * 10 + cast(c as int)) % 97)"


def _iban(m: str, key: str) -> str:
    """Country and letters stay, digits after the check digits are permuted, and the check digits follow from them."""
    plain = f"regexp_replace({m}, ' ', '')"
    digits = "regexp_replace(substr(w, 5), '[^0-9]', '')"
    body = f"transform(array(w), w -> {_refill('substr(w, 5)', _any_digits_permuted(digits, 'iban', key))})[0]"
    check = f"lpad(cast(98 - {_mod97('concat(q, left(w, 2), chr(48), chr(48))')} as string), 2, '0')"
    made = f"transform(array({body}), q -> concat(left(w, 2), {check}, q))[0]"
    spaced = f"aggregate(split({m}, ''), named_struct('o', '', 'k', 1), (z, c) -> if(c = ' ', named_struct('o', concat(z.o, c), 'k', z.k), named_struct('o', concat(z.o, substr(v, z.k, 1)), 'k', z.k + 1)), z -> z.o)"
    valid = f"{_mod97('concat(substr(w, 5), left(w, 4))')} = 1 and length({digits}) >= 6"
    return f"transform(array({plain}), w -> if({valid}, transform(array({made}), v -> {spaced})[0], {m}))[0]"


def _phone(m: str, key: str) -> str:
    digits = f"right(regexp_replace({m}, '[^0-9]', ''), 10)"
    step = _digits_permuted("x.v", 10, "phone", key)
    valid = "rlike '^[2-9][0-9]{2}[2-9]'"
    body = f"transform(array({digits}), d -> {_walked('d', step, f'(v {valid}) = (d {valid})', WALK_PHONE)})[0]"
    return _refill(m, f"concat(left(regexp_replace({m}, '[^0-9]', ''), length(regexp_replace({m}, '[^0-9]', '')) - 10), {body})")


def _world_phone(m: str, key: str) -> str:
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    code = f"regexp_extract(d, '^({COUNTRY_CODES})', 1)"
    body = _any_digits_permuted("substr(d, length(h) + 1)", "phone', h, '", key)
    made = f"transform(array({digits}), d -> transform(array({code}), h -> concat(h, {body}))[0])[0]"
    return f"if(length({digits}) between 8 and 15, {_refill(m, made)}, {m})"


def _ssn(m: str, key: str) -> str:
    valid = "rlike '^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}$'"
    digits = f"regexp_replace({m}, '-', '')"
    return f"if({digits} {valid}, {_refill(m, _walked(digits, _digits_permuted('x.v', 9, 'ssn', key), 'v ' + valid))}, {m})"


def _ipv4(m: str, key: str) -> str:
    part = lambda i: f"cast(split({m}, '[.]')[{i}] as int)"
    s = _feistel(f"{part(0)} * 256 + {part(1)}", f"{part(2)} * 256 + {part(3)}", "65536", "65536", "ipv4", key)
    new = f"transform(array({s}), r -> concat_ws('.', cast(r.a div 256 as string), cast(r.a % 256 as string), cast(r.b div 256 as string), cast(r.b % 256 as string)))[0]"
    return f"if(forall(split({m}, '[.]'), o -> cast(o as int) <= 255), {new}, {m})"


def _date(m: str, key: str) -> str:
    iso = f"if({m} like '%-%', {m}, concat(substr({m}, 7, 4), '-', substr({m}, 4, 2), '-', substr({m}, 1, 2)))"
    us = f"concat(substr({m}, 7, 4), '-', substr({m}, 1, 2), '-', substr({m}, 4, 2))"
    day = f"coalesce(try_cast({iso} as date), if({m} like '%/%', try_cast({us} as date), null))"
    span, side = "datediff(date'2100-01-01', date'1900-01-01')", 271
    pair = _feistel(f"x.v div {side}", f"x.v % {side}", str(side), str(side), "date", key)
    step = f"transform(array({pair}), r -> r.a * {side} + r.b)[0]"
    walked = _walked(f"cast(datediff({day}, date'1900-01-01') as bigint)", step, f"v < {span}")
    new = f"date_add(date'1900-01-01', cast({walked} as int))"
    shape = f"case when {m} like '%-%' then 'yyyy-MM-dd' when try_cast({iso} as date) is not null then 'dd/MM/yyyy' else 'MM/dd/yyyy' end"
    return f"if({day} is null, {m}, date_format({new}, {shape}))"


def _digest(kind: str, value: str, key: str) -> str:
    return f"sha2(concat({_text(key)}, ':{kind}:', {value}), 256)"


def _as_long(digest: str, value: str) -> str:
    """The digest, repeated to the length of ``value``."""
    return f"substr(repeat({digest}, cast(ceil(length({value}) / 64) as int)), 1, length({value}))"


def _pseudonym(m: str, key: str) -> str:
    value = f"regexp_extract({m}, '[=:][ \\\\t]*\"?([^\"]*)\"?$', 1)"
    shaped = _as_long(_digest("credential", value, key), value)
    hexed = _as_long(_digest("hex_token", f"lower({m})", key), m)
    prefix = f"regexp_extract({m}, '^([^=:]*[=:][ \\\\t]*\"?)', 1)"
    kind = {name: _text(f"^(?:{pattern})$") for name, pattern in KINDS}
    made = {
        "credential": f"concat({prefix}, {shaped}, if({m} like '%\"', '\"', ''))",
        "access_key": f"concat(left({m}, 4), upper(substr({_digest('access_key', m, key)}, 1, 16)))",
        "hex_token": f"if({m} rlike '[a-f]', {hexed}, upper({hexed}))",
        "email": f"transform(array({_digest('email', f'lower({m})', key)}), h -> concat('u', substr(h, 1, 12), '@', substr(h, 13, 8), '.invalid'))[0]",
        "date": _date(m, key), "ipv4": _ipv4(m, key), "ssn": _ssn(m, key), "phone": _phone(m, key), "world_phone": _world_phone(m, key), "card": _card(m, key), "iban": _iban(m, key),
    }
    return "case " + " ".join(f"when {m} rlike {kind[k]} then named_struct('kind', '{k.removeprefix('world_')}', 'text', {made[k]})" for k, _ in KINDS) + f" else named_struct('kind', 'none', 'text', {m}) end"


def pseudonymise(docs: DataFrame, key: str = KEY, column: str = "text", kinds_column: str = "pii_kinds") -> DataFrame:
    """``docs`` with pseudonyms in ``column``, and in ``kinds_column`` the sorted kinds that were replaced, one for each place."""
    text = F.col(column).cast("string")
    # One pass tells most texts from those that need the whole pattern; each kind must pass it.
    some = text.rlike("[0-9@]|AKIA|ASIA|[A-Fa-f]{32}|(?i:password|passwd|pwd|secret|token|api[_-]?key)[ \\t]{0,3}[=:]")
    found = F.when(some, F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    found_name, new_name = (free_name(f"_pii_{x}", docs.columns) for x in ("found", "new"))
    out = docs.withColumn(found_name, found).withColumn(new_name, F.expr(f"transform(`{found_name}`, m -> {_pseudonym('m', key)})"))
    forget_parser(docs.sparkSession)
    # Split by the same pattern: one gap more than matches.
    gaps = F.split(text, PATTERN, -1)
    joined = F.array_join(F.zip_with(gaps, F.concat(F.transform(F.col(new_name), lambda x: x["text"]), F.array(F.lit(""))), lambda g, r: F.concat(g, r)), "")
    changed = F.filter(F.zip_with(F.col(new_name), F.col(found_name), lambda n, f: F.struct(n["kind"].alias("kind"), (n["text"] != f).alias("changed"))), lambda x: x["changed"])
    kinds = F.array_sort(F.transform(changed, lambda x: x["kind"]))
    made = {column: F.when(F.size(found_name) > 0, joined).otherwise(text), kinds_column: F.coalesce(kinds, F.array().cast("array<string>"))}
    return out.select(*[F.col(f"`{c}`") if c not in made else made[c].alias(c) for c in docs.columns], *[v.alias(c) for c, v in made.items() if c not in docs.columns])
