"""Captures made of packets given by their fields."""

from __future__ import annotations

import struct


def ip_packet(src: str, dst: str, sport: int, dport: int, proto: int = 6, flags: int = 0x10, data: bytes = b"", ttl: int = 64, window: int = 512) -> bytes:
    """An IPv4 packet with a TCP or UDP header (none for other protocols)."""
    if proto == 6:
        l4 = struct.pack(">HHIIBBHHH", sport, dport, 1, 2, 0x50, flags, window, 0, 0) + data
    elif proto == 17:
        l4 = struct.pack(">HHHH", sport, dport, 8 + len(data), 7) + data
    else:
        l4 = data
    quad = lambda a: bytes(map(int, a.split(".")))
    return struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(l4), 0, 0, ttl, proto, 0, quad(src), quad(dst)) + l4


def ethernet(packet: bytes) -> bytes:
    return b"\0" * 12 + b"\x08\x00" + packet


def cooked(packet: bytes) -> bytes:
    return b"\0" * 14 + b"\x08\x00" + packet


def pcap_file(frames: list[tuple[int, bytes]], link: int = 1) -> bytes:
    """frames: microseconds and bytes."""
    return struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, link) + b"".join(struct.pack("<IIII", t // 1_000_000, t % 1_000_000, len(f), len(f)) + f for t, f in frames)


def pcapng_file(frames: list[tuple[int, bytes]], link: int = 1) -> bytes:
    block = lambda kind, body: struct.pack("<II", kind, 12 + len(body)) + body + struct.pack("<I", 12 + len(body))
    out = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", link, 0, 0))
    for t, f in frames:
        out += block(6, struct.pack("<IIIII", 0, t >> 32, t & 0xFFFFFFFF, len(f), len(f)) + f + b"\0" * (-len(f) % 4))
    return out
