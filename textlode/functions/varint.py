"""Variable-length integers, seven bits a byte, lowest first. Parquet's encodings do this work in the index itself."""

from __future__ import annotations


def encode_varint(value: int) -> bytes:
    """1 to 5 bytes; a negative number counts as its 32-bit two's complement."""
    rest, out = value & 0xFFFFFFFF, bytearray()
    while rest > 0x7F:
        out.append(rest & 0x7F | 0x80)
        rest >>= 7
    return bytes(out + bytes([rest]))


def decode_varint(data: bytes, at: int = 0) -> tuple[int, int]:
    """(value, place after it) of the number that begins at ``at``."""
    total = 0
    for i, byte in enumerate(data[at : at + 5]):
        total |= (byte & 0x7F) << (7 * i)
        if byte < 0x80:
            total &= 0xFFFFFFFF
            return (total - (1 << 32) if total >> 31 else total), at + i + 1
    raise ValueError("malformed variable-length integer")
