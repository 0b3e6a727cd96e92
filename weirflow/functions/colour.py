"""Colour and bit packing as columns; channels are whole numbers from 0 to 255."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed weights of red, green and blue.
LUMINANCE = {"perceived": (0.299, 0.587, 0.114), "standard": (0.2126, 0.7152, 0.0722), "average": (1 / 3, 1 / 3, 1 / 3)}


def rgb_hex(r: Column, g: Column, b: Column) -> Column:
    return F.lower(F.concat(F.lit("#"), *(F.lpad(F.hex(c.cast("long")), 2, "0") for c in (r, g, b))))


def hex_channel(code: Column, k: int) -> Column:
    """Channel 0, 1 or 2 of #rrggbb."""
    return F.conv(F.substring(code, 2 + 2 * k, 2), 16, 10).cast("int")


def lightness(r: Column, g: Column, b: Column, method: str = "perceived") -> Column:
    if method == "lightness":
        return (F.greatest(r, g, b) + F.least(r, g, b)) / 2
    wr, wg, wb = LUMINANCE[method]
    return wr * r + wg * g + wb * b


def pack16(r: Column, g: Column, b: Column) -> Column:
    """Five, six and five bits."""
    return F.shiftleft(F.shiftright(r, 3), 11).bitwiseOR(F.shiftleft(F.shiftright(g, 2), 5)).bitwiseOR(F.shiftright(b, 3))


def unpack16(code: Column) -> list[Column]:
    return [F.shiftleft(F.shiftright(code, 11).bitwiseAND(31), 3), F.shiftleft(F.shiftright(code, 5).bitwiseAND(63), 2), F.shiftleft(code.bitwiseAND(31), 3)]


def pack24(r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(r, 16).bitwiseOR(F.shiftleft(g, 8)).bitwiseOR(b)


def blend(c: Column, towards: int, amount: float = 0.2) -> Column:
    """Part of the way to white (255) or black (0)."""
    return F.round(c + (towards - c) * amount).cast("int")


def hsv_to_rgb(h: Column, s: Column, v: Column) -> list[Column]:
    """Red, green and blue from 0 to 1 of a hue in degrees, saturation and value from 0 to 1."""
    sixth = h / 60.0
    f = sixth - F.floor(sixth)
    k = F.pmod(F.floor(sixth).cast("long"), F.lit(6))
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    value, p, q, t = clip(v), clip(v * (1 - s)), clip(v * (1 - f * s)), clip(v * (1 - (1 - f) * s))
    order = [(value, q, p, p, t, value), (t, value, value, q, p, p), (p, p, t, value, value, q)]
    return [F.element_at(F.array(*c), (k + 1).cast("int")) for c in order]


def rgb_to_hcl(r: Column, g: Column, b: Column, method: str = "perceived") -> list[Column]:
    """Hue in radians, chroma and luminance."""
    alpha, beta = (2 * r - g - b) / 2, (3**0.5) / 2 * (g - b)
    return [F.atan2(beta, alpha), F.sqrt(alpha * alpha + beta * beta), lightness(r, g, b, method)]


def hue_angle(first: list[Column], second: list[Column]) -> Column:
    """Difference of two colours' hues in radians, from -pi to pi."""
    d = rgb_to_hcl(*first)[0] - rgb_to_hcl(*second)[0]
    return F.atan2(F.sin(d), F.cos(d))


def rotated(r: Column, g: Column, b: Column, turn: Column) -> list[Column]:
    """Colours turned about the grey axis by an angle in radians; they may leave the range from 0 to 1.

    The turn is that of a vector about (1, 1, 1): its part along the axis stays, the rest turns."""
    grey = (r + g + b) / 3
    c, s = F.cos(turn), F.sin(turn) / (3**0.5)
    return [grey + (x - grey) * c + (z - y) * s for x, y, z in ((r, g, b), (g, b, r), (b, r, g))]


def matched_luminance(r: Column, g: Column, b: Column, target: Column, rounds: int = 40, method: str = "perceived") -> list[Column]:
    """Colours moved step by step to a luminance, half by adding and half by scaling, each channel kept from 0 to 1."""
    wr, wg, wb = LUMINANCE[method]
    clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))

    def step(c: Column, _: Column) -> Column:
        now = wr * c[0] + wg * c[1] + wb * c[2]
        move = lambda x: 0.9 * x + 0.05 * (clip(x + target - now) + clip(x * target / F.greatest(now, F.lit(1e-12))))
        return F.transform(c, move)

    made = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.array(r.cast("double"), g.cast("double"), b.cast("double")), step)
    return [made[k] for k in range(3)]
