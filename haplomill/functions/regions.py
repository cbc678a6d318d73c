"""Region strings such as chr1:20000-60000."""

from __future__ import annotations

from itertools import takewhile

AUTOSOMES = 22


def _whole(digits: str, what: str, text: str) -> int:
    if not digits.isdecimal():
        raise ValueError(f"{text!r} has no {what}; a region is [chr][number:]start-end")
    return int(digits)


def parse_region(text: str) -> tuple[str | None, int, int]:
    """(chromosome or None, start, end). What follows the digits of the end is ignored."""
    before, _, after = text.partition("-")
    name, colon, first = before.rpartition(":")
    start = _whole(first, "start", text)
    end = _whole("".join(takewhile(str.isdecimal, after)), "end", text)
    if end < start:
        raise ValueError(f"{text!r} ends before it starts")
    if not colon:
        return None, start, end
    chromosome = name.removeprefix("chr")
    if not 1 <= _whole(chromosome, "chromosome number", text) <= AUTOSOMES:
        raise ValueError(f"{text!r} is on none of the chromosomes 1 to {AUTOSOMES}")
    return chromosome, start, end
