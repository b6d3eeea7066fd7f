"""Texts that name ranges, axes and renamings."""

from __future__ import annotations

AXES = "TCZYX"


def frame_range(text: str | None) -> tuple[int | None, int | None]:
    """First and last frame, counted from 0 and both included, of "10" or "2-40", counted from 1. (None, None) of none."""
    if text is None or not text.strip():
        return None, None
    ends = text.strip().split("-")
    if len(ends) > 2 or not all(e.strip().isdigit() for e in ends):
        raise ValueError(f"not a range: {text!r}")
    first, last = int(ends[0]), int(ends[-1])
    if first < 1 or last < first:
        raise ValueError(f"a range starts at 1 or later and doesn't end before its start: {text!r}")
    return first - 1, last - 1


def substack_ranges(text: str | None, first_axis: str = "T") -> dict[str, tuple[int, int]]:
    """Half-open ranges from 0 by axis, of "T:4-10;Z:2-20" or of a bare range, which means the first axis."""
    if text is None or not text.strip():
        return {}
    if ":" not in text:
        text = f"{first_axis}:{text}"
    out: dict[str, tuple[int, int]] = {}
    for part in filter(None, (p.strip() for p in text.split(";"))):
        axis, _, span = part.partition(":")
        axis = axis.strip().upper()
        if axis not in AXES or len(axis) != 1 or axis in out:
            raise ValueError(f"not an axis, or given twice: {part!r}")
        first, last = frame_range(span)
        if first is None:
            raise ValueError(f"no range for {axis}")
        out[axis] = (first, last + 1)
    return out


def renames(text: str | None) -> dict[str, str]:
    """{"Red": "Dpn", "Blue": "EDU"} of "Red:Dpn;Blue:EDU"."""
    out = {}
    for part in filter(None, (p.strip() for p in (text or "").split(";"))):
        old, colon, new = part.partition(":")
        if not colon or not old.strip() or not new.strip():
            raise ValueError(f"not old:new: {part!r}")
        out[old.strip()] = new.strip()
    return out


def axes_of(rank: int) -> str:
    """Letters of the axes of an array of so many; letters further along the alphabet stand in front of ranks above five."""
    if rank < 2:
        raise ValueError("an image has at least two axes")
    usual = {2: "YX", 3: "ZYX", 4: "CZYX", 5: AXES}
    return usual.get(rank) or "".join(chr(ord("A") + k) for k in range(rank - 2)) + "YX"
