"""Bit strings, most significant bit first."""

from __future__ import annotations


class BitWriter:
    """Collects fields; ``bytes()`` pads the last byte with zeros."""

    def __init__(self) -> None:
        self._whole = bytearray()
        self._rest, self._held = 0, 0

    def put(self, value: int, width: int) -> BitWriter:
        if value < 0 or value >> width:
            raise ValueError(f"{value} does not fit {width} bits")
        self._rest, self._held = self._rest << width | value, self._held + width
        spare = self._held & 7
        if self._held >= 8:
            self._whole += (self._rest >> spare).to_bytes(self._held >> 3, "big")
            self._rest &= (1 << spare) - 1
            self._held = spare
        return self

    def flag(self, value: bool) -> BitWriter:
        return self.put(int(bool(value)), 1)

    def align(self) -> BitWriter:
        return self.put(0, -self._held % 8)

    @property
    def size(self) -> int:
        """Bits written."""
        return len(self._whole) * 8 + self._held

    def bytes(self) -> bytes:
        tail = bytes([self._rest << 8 - self._held]) if self._held else b""
        return bytes(self._whole) + tail


class BitReader:
    """Reads fields of a byte string; running over its end is an error."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at = bytes(data), at * 8

    def take(self, width: int) -> int:
        end = self.at + width
        if end > len(self.data) * 8:
            raise ValueError("the bit string ends early")
        first, last = self.at >> 3, end + 7 >> 3
        word = int.from_bytes(self.data[first:last], "big") >> last * 8 - end
        self.at = end
        return word & (1 << width) - 1

    def peek(self, width: int) -> int:
        """The next bits, with zeros behind the end."""
        first = self.at >> 3
        word = int.from_bytes(self.data[first : first + 4], "big") << 8 * max(0, first + 4 - len(self.data))
        return word >> 32 - width - (self.at & 7) & (1 << width) - 1

    def skip(self, width: int) -> None:
        self.at += width
        if self.at > len(self.data) * 8:
            raise ValueError("the bit string ends early")

    def flag(self) -> bool:
        return bool(self.take(1))

    def align(self) -> None:
        self.at = self.at + 7 & ~7

    @property
    def byte(self) -> int:
        return self.at + 7 >> 3


def seven_bit(value: int) -> bytes:
    """Big-endian groups of seven bits, the high bit set on all but the last."""
    groups = [value & 127]
    while value := value >> 7:
        groups.append(value & 127 | 128)
    return bytes(reversed(groups))


def read_seven_bit(data: bytes, at: int) -> tuple[int, int]:
    """Value and the place behind it."""
    value = 0
    while True:
        if at >= len(data):
            raise ValueError("the number ends early")
        value, more, at = value << 7 | data[at] & 127, data[at] & 128, at + 1
        if not more:
            return value, at
