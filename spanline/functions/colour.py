"""Colours as columns: CIELAB from 8-bit sRGB, and the CIEDE2000 difference."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: sRGB to XYZ by rows, and the D65 white point.
TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
WHITE = (0.95047, 1.0, 1.08883)


def linear(channel: Column) -> Column:
    x = channel / 255.0
    return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))


def lab(red: Column, green: Column, blue: Column) -> Column:
    """A struct of l, a and b."""
    rgb = [linear(c) for c in (red, green, blue)]
    f = lambda t: F.when(t > (6 / 29) ** 3, F.cbrt(t)).otherwise(t / (3 * (6 / 29) ** 2) + 4 / 29)
    x, y, z = (f((row[0] * rgb[0] + row[1] * rgb[1] + row[2] * rgb[2]) / w) for row, w in zip(TO_XYZ, WHITE, strict=True))
    return F.struct((116 * y - 16).alias("l"), (500 * (x - y)).alias("a"), (200 * (y - z)).alias("b"))


def bound(value: Column, use) -> Column:
    """use(value), with value worked out once."""
    return F.transform(F.array(value), use)[0]


def ciede2000(first: Column, second: Column) -> Column:
    """The difference of two structs of l, a and b, all weights 1: chroma is corrected near the grey axis, hue differences are weighed, and blue is turned."""
    chroma = lambda c: F.sqrt(c["a"] * c["a"] + c["b"] * c["b"])
    fade = lambda c: F.sqrt(F.pow(c, F.lit(7)) / (F.pow(c, F.lit(7)) + 25.0**7))
    hue = lambda a, b: F.when((a == 0) & (b == 0), 0.0).otherwise(F.pmod(F.degrees(F.atan2(b, a)), F.lit(360.0)))
    wave = lambda angle, times, shift: F.cos(F.radians(times * angle + shift))

    def with_grey(g: Column) -> Column:
        polar = lambda c: F.struct(c["l"].alias("l"), F.sqrt((c["a"] * (1 + g)) * (c["a"] * (1 + g)) + c["b"] * c["b"]).alias("c"), hue(c["a"] * (1 + g), c["b"]).alias("h"))
        return bound(F.struct(polar(first).alias("x"), polar(second).alias("y")), with_polar)

    def with_polar(p: Column) -> Column:
        x, y = p["x"], p["y"]
        apart = y["h"] - x["h"]
        grey = x["c"] * y["c"] == 0
        turn = F.when(grey, 0.0).when(apart > 180, apart - 360).when(apart < -180, apart + 360).otherwise(apart)
        total = x["h"] + y["h"]
        middle = F.when(grey, total).when(F.abs(apart) <= 180, total / 2).when(total < 360, total / 2 + 180).otherwise(total / 2 - 180)
        fields = {"dl": y["l"] - x["l"], "dc": y["c"] - x["c"], "dh": 2 * F.sqrt(x["c"] * y["c"]) * F.sin(F.radians(turn / 2)), "l": (x["l"] + y["l"]) / 2, "c": (x["c"] + y["c"]) / 2, "h": middle}
        return bound(F.struct(*[v.alias(k) for k, v in fields.items()]), with_means)

    def with_means(m: Column) -> Column:
        h, c = m["h"], m["c"]
        weight = 1 - 0.17 * wave(h, 1, -30) + 0.24 * wave(h, 2, 0) + 0.32 * wave(h, 3, 6) - 0.20 * wave(h, 4, -63)
        light = (m["l"] - 50) * (m["l"] - 50)
        a, b, d = m["dl"] / (1 + 0.015 * light / F.sqrt(20 + light)), m["dc"] / (1 + 0.045 * c), m["dh"] / (1 + 0.015 * c * weight)
        bend = (h - 275) / 25
        rotation = -2 * fade(c) * F.sin(F.radians(60 * F.exp(-bend * bend)))
        return F.sqrt(a * a + b * b + d * d + rotation * b * d)

    return bound(0.5 * (1 - fade((chroma(first) + chroma(second)) / 2)), with_grey)
