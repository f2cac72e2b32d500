"""Words of byte strings: runs of anything but ASCII white space."""

from __future__ import annotations

import re

SLICE_BYTES = 1 << 22
SPACE = re.compile(rb"[\x20\x09-\x0d]")


def word_slices(raw: bytes, size: int = SLICE_BYTES):
    """The words of ``raw`` in lists of about ``size`` bytes of text."""
    at = 0
    while len(raw) - at > size:
        cut = SPACE.search(raw, at + size)
        if cut is None:
            break
        yield raw[at:cut.start()].split()
        at = cut.start()
    yield (raw[at:] if at else raw).split()
