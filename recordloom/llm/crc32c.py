"""CRC-32C of many byte strings at a time, and its masked form.

A checksum is linear in its input, so a string is cut into blocks, the blocks of
all strings are reduced side by side with numpy, and the results of one string
are chained with tables that move a checksum over a block of zeros.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

POLYNOMIAL = 0x82F63B78  # fixed value: CRC-32C, bits reversed
MASK_DELTA = 0xA282EAD8  # fixed value: of the masked form used in record files
BLOCK = 512
STEP = 8


@lru_cache(maxsize=1)
def _tables() -> np.ndarray:
    """STEP tables of 256: the checksum of a byte followed by k zero bytes."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1)
    tables = [table.astype(np.uint32)]
    for _ in range(STEP - 1):
        last = tables[-1]
        tables.append(tables[0][last & 0xFF] ^ (last >> 8))
    return np.array(tables)


def _over_zeros(state: np.ndarray, count: int) -> np.ndarray:
    first = _tables()[0]
    for _ in range(count):
        state = first[state & 0xFF] ^ (state >> 8)
    return state


@lru_cache(maxsize=1)
def _block_tables() -> list[list[int]]:
    """For each byte of a state, what it becomes after BLOCK zero bytes."""
    bytes_ = np.arange(256, dtype=np.uint32)
    return [_over_zeros(bytes_ << np.uint32(8 * k), BLOCK).tolist() for k in range(4)]


def crc32c_all(strings: list[bytes]) -> list[int]:
    """The checksums of ``strings``."""
    tables = _tables()
    heads = [len(s) % BLOCK for s in strings]
    # What is left over by whole blocks stands in front and is done separately.
    blocks = b"".join(s[h:] for s, h in zip(strings, heads, strict=True))
    rows = np.frombuffer(blocks, dtype=np.uint8).reshape(-1, BLOCK)
    state = np.zeros(len(rows), dtype=np.uint32)
    for at in range(0, BLOCK, STEP):
        part = rows[:, at : at + STEP]
        low = part[:, :4].copy().view("<u4")[:, 0] ^ state
        state = (
            tables[7][low & 0xFF]
            ^ tables[6][(low >> 8) & 0xFF]
            ^ tables[5][(low >> 16) & 0xFF]
            ^ tables[4][low >> 24]
            ^ tables[3][part[:, 4]]
            ^ tables[2][part[:, 5]]
            ^ tables[1][part[:, 6]]
            ^ tables[0][part[:, 7]]
        )
    done = state.tolist()
    t0, t1, t2, t3 = _block_tables()
    starts = _head_states(strings, heads)
    found, next_block = [], 0
    for string, head, value in zip(strings, heads, starts, strict=True):
        for _ in range((len(string) - head) // BLOCK):
            value = (
                t0[value & 0xFF]
                ^ t1[(value >> 8) & 0xFF]
                ^ t2[(value >> 16) & 0xFF]
                ^ t3[value >> 24]
                ^ done[next_block]
            )
            next_block += 1
        found.append(value ^ 0xFFFFFFFF)
    return found


def _head_states(strings: list[bytes], heads: list[int]) -> list[int]:
    """The states after the first len % BLOCK bytes, all strings side by side,
    right-aligned: a string joins in when its first byte comes."""
    if not strings:
        return []
    first = _tables()[0]
    sizes = np.array(heads)
    order = np.argsort(-sizes, kind="stable")  # the longest heads come first
    lengths = sizes[order]
    widest = int(lengths[0])
    rows = np.zeros((len(strings), widest), dtype=np.uint8)
    for row, index in enumerate(order.tolist()):
        head = heads[index]
        if head:
            rows[row, widest - head :] = np.frombuffer(strings[index], np.uint8, head)
    state = np.full(len(strings), 0xFFFFFFFF, dtype=np.uint32)
    joined = np.searchsorted(-lengths, -(widest - np.arange(widest)), side="right")
    columns = np.ascontiguousarray(rows.T)
    for at in range(widest):
        n = int(joined[at])
        now = state[:n]
        state[:n] = first[(now ^ columns[at, :n]) & 0xFF] ^ (now >> 8)
    back = np.empty_like(state)
    back[order] = state
    return back.tolist()


def masked(checksum: int) -> int:
    """Rotated and shifted, so that a checksum over data that holds checksums
    is no weaker."""
    return (((checksum >> 15) | (checksum << 17)) + MASK_DELTA) & 0xFFFFFFFF


def unmasked(value: int) -> int:
    turned = (value - MASK_DELTA) & 0xFFFFFFFF
    return ((turned >> 17) | (turned << 15)) & 0xFFFFFFFF
