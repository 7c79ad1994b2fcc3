"""Colours as four channel columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import half_up


def hex_color(r: Column, g: Column, b: Column) -> Column:
    two = lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")
    return F.concat(F.lit("#"), two(r), two(g), two(b))


def with_alpha(r: Column, g: Column, b: Column, alpha: Column) -> tuple[Column, ...]:
    return r, g, b, alpha


def age_hue(age: Column) -> Column:
    """Hue in whole degrees: the age in 0..255, not stretched to 360."""
    return half_up(age * 255.0)


def hue_to_rgb(hue: Column) -> tuple[Column, Column, Column]:
    """RGB 0..255 of a fully saturated hue at half lightness.

    Whole hues often land on exactly half a step (hue 2 is 8.5), so the order of
    the floating-point operations is that of the usual HSL conversion.
    """

    def channel(shift: float) -> Column:
        turn = hue.cast("double") / 360.0 + shift
        turn = F.when(turn < 0, turn + 1.0).when(turn > 1, turn - 1.0).otherwise(turn)
        level = (
            F.when(turn * 6.0 < 1, turn * 6.0)
            .when(turn * 2.0 < 1, F.lit(1.0))
            .when(turn * 3.0 < 2, (F.lit(2.0 / 3.0) - turn) * 6.0)
            .otherwise(F.lit(0.0))
        )
        return half_up(level * 255.0).cast("int")

    return channel(1.0 / 3.0), channel(0.0), channel(-1.0 / 3.0)


def age_label(time: Column) -> Column:
    """Million years, padded on the left to three characters and never cut."""
    text = half_up(time * 280.0).cast("string")
    return F.lpad(text, F.greatest(F.lit(3), F.length(text)), F.lit(" "))
