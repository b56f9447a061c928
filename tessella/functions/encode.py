"""Encodings whose byte order is that of what they encode, and plain ones."""

from __future__ import annotations

import base64
import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

_STANDARD = string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/"
#: The same 64 digits in byte order, so that encoded keys sort as the keys.
ORDERED = "+/" + string.digits + string.ascii_uppercase + string.ascii_lowercase


def zero_escape(raw: bytes) -> bytes:
    """Each run of n zero bytes, 255 at most, as a zero and a byte n."""
    return re.sub(rb"\0{1,255}", lambda m: b"\0" + bytes([len(m[0])]), raw)


def zero_unescape(raw: bytes) -> bytes:
    if re.sub(rb"\0.", b"", raw, flags=re.S).endswith(b"\0"):
        raise ValueError("a zero without its count at the end")
    return re.sub(rb"\0(.)", lambda m: b"\0" * m[1][0], raw, flags=re.S)


def encode_tuple(parts: list[bytes]) -> bytes:
    """Parts escaped and ended by two zeros: tuples without adjacent zero bytes compare as their encodings do."""
    return b"\0\0".join(zero_escape(p) for p in parts)


def decode_tuple(raw: bytes) -> list[bytes]:
    out, at, start = [], 0, 0
    while at < len(raw):
        if raw[at] == 0:
            if raw[at + 1 : at + 2] == b"\0":
                out.append(zero_unescape(raw[start:at]))
                start = at = at + 2
                continue
            at += 1
        at += 1
    return [*out, zero_unescape(raw[start:])]


def tuple_key(*parts: Column) -> Column:
    """encode_tuple as a column, on texts whose zero bytes stand alone."""
    nul = F.decode(F.unhex(F.lit("00")), "UTF-8")
    escaped = [F.replace(p, nul, F.concat(nul, F.decode(F.unhex(F.lit("01")), "UTF-8"))) for p in parts]
    return F.concat_ws("\0\0", *escaped)


def base64_ordered(c: Column, alphabet: str = ORDERED) -> Column:
    """Base64 in an alphabet of one's own, without padding."""
    return F.translate(F.rtrim(F.regexp_replace(F.base64(c), r"[\r\n]", ""), F.lit("=")), _STANDARD, alphabet)


def unbase64_ordered(c: Column, alphabet: str = ORDERED) -> Column:
    return F.unbase64(F.translate(c, alphabet, _STANDARD))


def base64_text(raw: bytes, alphabet: str = ORDERED) -> str:
    return base64.b64encode(raw).decode().rstrip("=").translate(str.maketrans(_STANDARD, alphabet))


def put_vint(n: int) -> bytes:
    """Seven bits a byte, lowest first, the top bit set on all but the last."""
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def get_vint(raw: bytes) -> tuple[int, int]:
    """(number, bytes read)."""
    n = 0
    for i, b in enumerate(raw):
        n |= (b & 127) << 7 * i
        if b < 128:
            return n, i + 1
    raise ValueError("a number without an end")


def interpolate(low: str, high: str, fraction: float, alphabet: str = string.printable[:95], length: int = 8) -> str:
    """The text that lies at a fraction of the way between two, both read as fractions in the alphabet's base."""
    digits = sorted(alphabet)
    at = {c: i + 1 for i, c in enumerate(digits)}
    base = len(digits) + 1
    value = lambda s: sum(at[c] * base ** (length - 1 - i) for i, c in enumerate(s[:length]))
    n = value(low) + round((value(high) - value(low)) * fraction)
    out = []
    for i in range(length):
        d, n = divmod(n, base ** (length - 1 - i))
        out.append(digits[d - 1] if d else "")
    return "".join(out)


def string_ord(s: bytes, longest: int | None = None, letters: bytes = bytes(range(256))) -> int:
    """Place of a string among all strings over an alphabet of up to so many letters, in order; longer ones are cut."""
    n = len(s) if longest is None else longest
    base, place = len(letters), 0
    below = [0] * (n + 1)  # strings of up to k letters, the empty one included
    for k in range(n + 1):
        below[k] = (below[k - 1] if k else 0) + base**k
    for i, c in enumerate(s[:n]):
        at = letters.find(c)
        if at < 0:
            raise ValueError(f"not a letter of the alphabet: {c!r}")
        place += 1 + at * below[n - i - 1]
    return place


def string_chr(place: int, longest: int, letters: bytes = bytes(range(256))) -> bytes:
    """The string of up to so many letters at a place."""
    base = len(letters)
    below = [(base ** (k + 1) - 1) // (base - 1) if base > 1 else k + 1 for k in range(longest + 1)]
    if not 0 <= place < below[longest]:
        raise ValueError(f"a place is from 0 to {below[longest] - 1}")
    out = bytearray()
    while place:
        at, place = divmod(place - 1, below[longest - len(out) - 1])
        out.append(letters[at])
    return bytes(out)


def interpolate_string(t: float, low: bytes, high: bytes, more: int = 8, letters: bytes = bytes(range(256))) -> bytes:
    """A string at a fraction of the way between two, of their common start and up to so many letters more."""
    from os.path import commonprefix

    t, start = min(1.0, max(0.0, t)), len(commonprefix([low, high]))
    a, b = (string_ord(x[start:], more, letters) for x in (low, high))
    return low[:start] + string_chr(a + int((b - a) * t), more, letters)


def encode_utf8(code: Column) -> Column:
    """Bytes of a code point up to 2^31 - 1 in UTF-8, of up to six bytes; null for any other number."""
    def bytes_of(n: int, mark: int) -> Column:
        tail = [(128, 6 * k, 63) for k in range(n - 2, -1, -1)]
        parts = [F.lit(mark).bitwiseOR(F.shiftright(c, 6 * (n - 1)))] + [F.lit(m).bitwiseOR(F.shiftright(c, s).bitwiseAND(F.lit(k))) for m, s, k in tail]
        return F.unhex(F.concat(*(F.lpad(F.hex(p), 2, "0") for p in parts)))

    c = code.cast("long")
    out = F.when((c >= 0) & (c < 1 << 7), F.unhex(F.lpad(F.hex(c), 2, "0")))
    for n, mark, top in ((2, 0xC0, 11), (3, 0xE0, 16), (4, 0xF0, 21), (5, 0xF8, 26), (6, 0xFC, 31)):
        out = out.when((c >= 0) & (c < 1 << top), bytes_of(n, mark))
    return out


def from_millis(c: Column) -> Column:
    """Microseconds of a raw time in milliseconds."""
    return c.cast("long") * 1000


def from_nanos(c: Column) -> Column:
    """Microseconds of a raw time in nanoseconds, rounded down."""
    return F.floor(c.cast("decimal(20,0)") / 1000).cast("long")


def bits_set(c: Column, at: int) -> Column:
    return c.bitwiseOR(F.lit(1 << at))


def bits_flip(c: Column, at: int) -> Column:
    return c.bitwiseXOR(F.lit(1 << at))


def bits_test(c: Column, at: int) -> Column:
    return F.getbit(c, F.lit(at)) == 1


def mem_dump(raw: Column, word: int = 4) -> Column:
    """Lower-case hex in words of so many bytes with spaces between."""
    return F.regexp_replace(F.lower(F.hex(raw)), f"(.{{{2 * word}}})(?=.)", "$1 ")
