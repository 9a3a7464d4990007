"""Keyed permutations: pseudonyms that cannot collide, and that the key alone undoes.

A Feistel network adds to one half of a value a keyed hash of the other half, in turns.
Every step can be taken back, whatever the hash, so different values stay different: a proof,
not a probability.  No table of what was handed out is needed, neither to mask nor to restore.

``permute_text`` works on the digits of a text in some alphabet and maps the texts of one
length onto each other; ``permute_number`` on the numbers below a limit, walking on from
a value beyond the limit until one below it is met.  Both are Column expressions.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

from .keyed import ALPHABET, as_column
from .text import bind

ROUNDS = 8
# Steps of a walk; beyond the limit lie at most 2 / sqrt(limit) + 1 / limit of the numbers.
WALKS = 64
HEX = "0123456789ABCDEF"
_BITS = "array<bigint>"


def _material(key, scope: str, turn: Column, of: Column, block: Column) -> Column:
    return F.sha2(F.concat_ws("|", as_column(key), F.lit(scope), turn.cast("string"), of, block.cast("string")), 256)


def _digits(key, scope: str, turn: Column, half: Column, n: Column, radix: int) -> Column:
    """``n`` digits that depend on the key and on a half, sixteen from each hash.

    The half as text and the hashes are bound: a lambda that named them would compute them
    for each of its elements, and the work would grow with the square of the length.
    """
    shown = F.array_join(F.transform(half, lambda d: d.cast("string")), ".")
    blocks = F.sequence(F.lit(0), F.floor((F.greatest(n, F.lit(1)) - 1) / 16).cast("int"))
    hashes = bind(shown, lambda of: F.transform(blocks, lambda b: _material(key, scope, turn, of, b)))
    places = F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: i < n)
    digit = lambda block, i: F.conv(F.substr(block, 4 * (i % 16) + 1, F.lit(4)), 16, 10).cast("bigint") % radix
    return bind(hashes, lambda of: F.transform(places, lambda i: digit(F.get(of, F.floor(i / 16).cast("int")), i)))


def _feistel(digits: Column, key, scope: str, radix: int, back: bool) -> Column:
    """Digits of a text, permuted among all texts of their length."""
    sign = -1 if back else 1

    def turn(acc: Column, t: Column) -> Column:
        # Even turns change the first half by the second, odd turns the second by the first.
        changed = F.when(t % 2 == 0, acc["a"]).otherwise(acc["b"])
        other = F.when(t % 2 == 0, acc["b"]).otherwise(acc["a"])
        added = F.zip_with(changed, _digits(key, scope, t, other, F.size(changed), radix), lambda x, y: F.pmod(x + sign * y, F.lit(radix).cast("bigint")))
        return bind(added, lambda new: F.struct(F.when(t % 2 == 0, new).otherwise(acc["a"]).alias("a"), F.when(t % 2 == 0, acc["b"]).otherwise(new).alias("b")))

    turns = F.array(*[F.lit(t) for t in (reversed(range(ROUNDS)) if back else range(ROUNDS))])

    def permuted(digits: Column) -> Column:
        n = F.size(digits)
        cut = F.floor(n / 2).cast("int")
        start = F.struct(F.slice(digits, F.lit(1), cut).cast(_BITS).alias("a"), F.slice(digits, cut + 1, n).cast(_BITS).alias("b"))
        return F.aggregate(turns, start, turn, lambda acc: F.concat(acc["a"], acc["b"]))

    return bind(digits, permuted)


def permute_text(c: Column, key, scope: str = "", alphabet: str | None = None) -> Column:
    """A pseudonym of the value's text: different for different texts, the same for the same key and scope.

    Without an alphabet it is the permuted UTF-8 bytes as hexadecimal digits, so that
    only the length shows.  With one (e.g. ``ALPHABET``, letters and digits) the
    characters of the alphabet are permuted among all ways to fill their places, and
    others stay: ``Jan-Piet`` becomes ``q0T-x8Rd``.  NULL stays NULL, an empty text empty.
    """
    return _masked(c, key, scope, alphabet, back=False)


def restore_text(c: Column, key, scope: str = "", alphabet: str | None = None) -> Column:
    """What ``permute_text`` was given.  What it cannot have made becomes NULL."""
    return _masked(c, key, scope, alphabet, back=True)


def _masked(c: Column, key, scope: str, alphabet: str | None, back: bool) -> Column:
    if alphabet is None:
        text = c.cast("string") if back else F.hex(F.encode(c.cast("string"), "UTF-8"))
        digits = F.transform(F.filter(F.split(text, ""), lambda ch: ch != ""), lambda ch: F.conv(ch, 16, 10).cast("bigint"))
        shown = F.array_join(F.transform(_feistel(digits, key, scope, 16, back), lambda d: F.substr(F.lit(HEX), d.cast("int") + 1, F.lit(1))), "")
        if not back:
            return F.when(c.isNotNull(), shown)
        sound = text.rlike("^([0-9A-F]{2})*$")
        return F.when(sound, F.try_to_binary(F.when(sound, shown), F.lit("hex")).cast("string"))
    if len(set(alphabet)) != len(alphabet) or not alphabet:
        raise ValueError("an alphabet has each of its characters once")
    letters = F.filter(F.split(c.cast("string"), ""), lambda ch: ch != "")
    place = lambda ch: F.instr(F.lit(alphabet), ch)
    digits = F.filter(F.transform(letters, lambda ch: place(ch).cast("bigint") - 1), lambda d: d >= 0)
    new = _feistel(digits, key, scope, len(alphabet), back)

    def filled(permuted: Column) -> Column:
        start = F.struct(F.lit("").alias("text"), F.lit(0).alias("used"))
        step = lambda acc, ch: F.when(
            place(ch) > 0,
            F.struct(F.concat(acc["text"], F.substr(F.lit(alphabet), F.get(permuted, acc["used"]).cast("int") + 1, F.lit(1))).alias("text"), (acc["used"] + 1).alias("used")),
        ).otherwise(F.struct(F.concat(acc["text"], ch).alias("text"), acc["used"].alias("used")))
        return F.aggregate(letters, start, step, lambda acc: acc["text"])

    return F.when(c.isNotNull(), bind(new, filled))


def _halves(limit: int) -> tuple[int, int]:
    """Ranges of two halves whose product is just enough."""
    a = isqrt(limit - 1) + 1
    return a, -(-limit // a)


def _walk(c: Column, limit: int, key, scope: str, back: bool) -> Column:
    if not 0 < limit <= 1 << 62:
        raise ValueError("the limit must lie between 1 and 2^62")
    a, b = _halves(limit)
    turns = F.array(*[F.lit(t) for t in (reversed(range(ROUNDS)) if back else range(ROUNDS))])
    draw = lambda t, half: F.conv(F.substring(_material(key, scope, t, half.cast("string"), F.lit(limit)), 1, 15), 16, 10).cast("bigint")
    sign = -1 if back else 1

    def step(acc: Column, t: Column) -> Column:
        first = F.pmod(acc["x"] + sign * (draw(t, acc["y"]) % a), F.lit(a).cast("bigint"))
        second = F.pmod(acc["y"] + sign * (draw(t, acc["x"]) % b), F.lit(b).cast("bigint"))
        return F.struct(F.when(t % 2 == 0, first).otherwise(acc["x"]).alias("x"), F.when(t % 2 == 0, acc["y"]).otherwise(second).alias("y"))

    def once(value: Column) -> Column:
        start = F.struct(F.call_function("div", value, F.lit(b).cast("bigint")).alias("x"), F.pmod(value, F.lit(b).cast("bigint")).alias("y"))
        return F.aggregate(turns, start, step, lambda acc: acc["x"] * b + acc["y"])

    value = c.cast("bigint")
    first = once(value)
    # One step always, further ones while the number lies beyond the limit.
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), first, lambda acc, _: F.when(acc < limit, acc).otherwise(once(acc)))
    lost = F.raise_error(F.lit(f"no number below {limit} after {WALKS} steps"))
    inside = value.isNotNull() & (value >= 0) & (value < limit)
    return F.when(inside, bind(walked, lambda w: F.when(w < limit, w).otherwise(lost.cast("bigint"))))


def permute_number(c: Column, limit: int, key, scope: str = "") -> Column:
    """A number below ``limit`` for each number from 0 below it, all different.  NULL for NULL and for others."""
    return _walk(c, limit, key, scope, back=False)


def restore_number(c: Column, limit: int, key, scope: str = "") -> Column:
    """What ``permute_number`` was given."""
    return _walk(c, limit, key, scope, back=True)


__all__ = ["ALPHABET", "permute_number", "permute_text", "restore_number", "restore_text"]
