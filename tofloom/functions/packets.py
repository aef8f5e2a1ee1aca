"""Bit fields of 64-bit packet words, and their inverse."""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

HEADER = 0x585054  # "TPX", little-endian
HEADER_FULL = 0x33585054  # "TPX3"


def bits(word: Column, shift: int, mask: int) -> Column:
    return F.shiftrightunsigned(word, shift).bitwiseAND(F.lit(mask).cast("long"))


def top(word: Column) -> Column:
    """The most significant byte."""
    return F.shiftrightunsigned(word, 56)


def is_header(word: Column) -> Column:
    return bits(word, 0, 0xFFFFFF) == HEADER


def is_full_header(word: Column) -> Column:
    return bits(word, 0, 0xFFFFFFFF) == HEADER_FULL


def is_tdc(word: Column) -> Column:
    return top(word) == 0x6F


def is_gdc(word: Column) -> Column:
    return top(word).bitwiseAND(F.lit(0xF0).cast("long")) == 0x40


def is_pixel(word: Column) -> Column:
    return top(word).bitwiseAND(F.lit(0xF0).cast("long")) == 0xB0


def packet_class(word: Column) -> Column:
    return F.when(is_tdc(word), "tdc").when(is_gdc(word), "gdc").when(is_pixel(word), "pixel").otherwise("other")


def header_chip(word: Column) -> Column:
    """Chip id: a signed byte."""
    raw = bits(word, 32, 0xFF)
    return F.when(raw > 127, raw - 256).otherwise(raw).cast("int")


def header_packets(word: Column) -> Column:
    return F.shiftrightunsigned(word, 51).cast("int")


def tdc32(word: Column) -> Column:
    return bits(word, 12, 0xFFFFFFFF)


def gdc_kind(word: Column) -> Column:
    return bits(word, 56, 0xF)


def gdc_lsb32(word: Column) -> Column:
    return bits(word, 16, 0xFFFFFFFF)


def gdc_msb16(word: Column) -> Column:
    return bits(word, 16, 0xFFFF)


def spidr(word: Column) -> Column:
    return bits(word, 0, 0xFFFF)


def ftoa(word: Column) -> Column:
    return bits(word, 16, 0xF).cast("int")


def tot(word: Column) -> Column:
    return bits(word, 20, 0x3FF).cast("int")


def toa(word: Column) -> Column:
    return bits(word, 30, 0x3FFF).cast("int")


def pixaddr(word: Column) -> Column:
    return bits(word, 44, 0xFFFF)


def raw_xy(word: Column) -> tuple[Column, Column]:
    """Column and row on the chip, 0 to 255."""
    address = pixaddr(word)
    pix = bits(address, 0, 7)
    x = F.shiftright(address.bitwiseAND(F.lit(0xFE00).cast("long")), 8) + F.shiftright(pix, 2)
    y = F.shiftright(address.bitwiseAND(F.lit(0x1F8).cast("long")), 1) + pix.bitwiseAND(F.lit(3).cast("long"))
    return x.cast("int"), y.cast("int")


#: layout -> chip -> (sign x, offset x, sign y, offset y); other chips stay as they are
LAYOUTS = {
    "gapped": {0: (1, 260, 1, 0), 1: (-1, 515, -1, 515), 2: (-1, 255, -1, 515)},
    "display": {0: (1, 256, 1, 0), 1: (-1, 511, -1, 511), 2: (-1, 255, -1, 511)},
}


def place(chip: Column, x: Column, y: Column, layout: str = "gapped") -> tuple[Column, Column]:
    """Chip coordinates on the detector canvas."""
    px, py = x, y
    for number, (sx, ox, sy, oy) in LAYOUTS[layout].items():
        px = F.when(chip == number, F.lit(ox) + sx * x).otherwise(px)
        py = F.when(chip == number, F.lit(oy) + sy * y).otherwise(py)
    return px.cast("int"), py.cast("int")


def spider_ticks(word: Column) -> Column:
    """``spidr * 16384 + toa``: 30 bits."""
    return spidr(word) * 16384 + toa(word)


def pixel_word(address: Column, toa_: Column, tot_: Column, ftoa_: Column, spidr_: Column) -> Column:
    """A pixel packet from its fields."""

    def up(c: Column, n: int) -> Column:
        return F.shiftleft(c.cast("long"), n)

    return (
        F.lit(-0x5000000000000000)
        .bitwiseOR(up(address, 44))
        .bitwiseOR(up(toa_, 30))
        .bitwiseOR(up(tot_, 20))
        .bitwiseOR(up(ftoa_, 16))
        .bitwiseOR(spidr_.cast("long"))
    )


def tdc_word(value: Column) -> Column:
    return F.lit(0x6F << 56).bitwiseOR(F.shiftleft(value.cast("long"), 12))


def gdc_words(value: Column) -> tuple[Column, Column]:
    """The two packets (low 32 bits, high 16 bits) of a 48-bit timestamp."""
    low = F.lit(0x44 << 56).bitwiseOR(F.shiftleft(value.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")), 16))
    high = F.lit(0x45 << 56).bitwiseOR(F.shiftleft(F.shiftright(value, 32).bitwiseAND(F.lit(0xFFFF).cast("long")), 16))
    return low, high


# -- packing bytes, for fixtures ----------------------------------------------


def pack_header(chip: int, packets: int) -> bytes:
    return b"TPX3" + struct.pack("<bBH", chip, 0, packets * 8)


def pack_pixel(address: int, toa_: int, tot_: int, ftoa_: int, spidr_: int) -> bytes:
    word = 0xB << 60 | address << 44 | toa_ << 30 | tot_ << 20 | ftoa_ << 16 | spidr_
    return struct.pack("<Q", word)


def pack_tdc(value: int) -> bytes:
    return struct.pack("<Q", 0x6F << 56 | (value & 0xFFFFFFFF) << 12)


def pack_gdc(value: int) -> bytes:
    low, high = value & 0xFFFFFFFF, value >> 32 & 0xFFFF
    return struct.pack("<QQ", 0x44 << 56 | low << 16, 0x45 << 56 | high << 16)
