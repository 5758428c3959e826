"""HDF5 files from the format's public specification: groups, datasets, attributes and chunks.

Reads superblocks 0 to 3, old and new object headers, compact links, symbol
tables, contiguous, compact and chunked layouts (version 3, indexed by a tree
of chunks) with the deflate, shuffle and checksum filters. Writes the oldest
form, which every reader knows. A chunk's place is found by descending the
tree, so nothing lists all chunks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from math import prod

import numpy as np

from ..meta import TensorError

#: Fixed values of the format.
SIGNATURE, NOWHERE = b"\x89HDF\r\n\x1a\n", 2**64 - 1
DATASPACE, LINK_INFO, DATATYPE, LINK, LAYOUT, FILTERS, ATTRIBUTE, CONTINUATION, SYMBOLS = 0x01, 0x02, 0x03, 0x06, 0x08, 0x0B, 0x0C, 0x10, 0x11
DEFLATE, SHUFFLE, CHECKSUM = 1, 2, 3
#: Entries of a node of the chunk tree, and of a symbol node, at most twice these.
CHUNK_K, GROUP_K, LEAF_K = 32, 16, 32


@dataclass
class Dataset:
    """A dataset's shape, type and where its elements lie."""

    shape: tuple[int, ...]
    dtype: np.dtype
    attributes: dict[str, object]
    chunks: tuple[int, ...] | None = None
    address: int = NOWHERE
    compact: bytes | None = None
    filters: list[tuple[int, tuple[int, ...]]] = field(default_factory=list)


class Reader:
    """Walks a file's metadata; ``read(at, n)`` gives bytes of the file."""

    def __init__(self, read: Callable[[int, int], bytes]):
        self.read = read
        head = read(0, 96)
        if head[:8] != SIGNATURE:
            raise TensorError("not an HDF5 file")
        version = head[8]
        if version > 3 or (head[13:15] if version < 2 else head[9:11]) != b"\x08\x08":
            raise TensorError("an HDF5 file of another version or address size")
        self.root = struct.unpack("<Q", head[64:72] if version == 0 else head[68:76] if version == 1 else head[36:44])[0]

    def messages(self, address: int) -> Iterator[tuple[int, bytes]]:
        """Type and body of every message of an object header."""
        head = self.read(address, 16)
        if head[:4] == b"OHDR":
            flags, at = head[5], 6 + 16 * bool(head[5] & 0x20) + 4 * bool(head[5] & 0x10)
            width = 1 << (flags & 3)
            size = int.from_bytes(self.read(address + at, width), "little")
            blocks, order = [(address + at + width, size)], 2 * bool(flags & 4)
            while blocks:
                begin, size = blocks.pop(0)
                raw, at = self.read(begin, size), 0
                while at + 4 + order <= size:
                    kind, n = raw[at], struct.unpack("<H", raw[at + 1 : at + 3])[0]
                    body = raw[at + 4 + order : at + 4 + order + n]
                    if kind == CONTINUATION:
                        where, length = struct.unpack("<QQ", body[:16])
                        blocks.append((where + 4, length - 8))  # without signature and checksum
                    else:
                        yield kind, body
                    at += 4 + order + n
            return
        if head[0] != 1:
            raise TensorError("an object header of another version")
        left, size = struct.unpack("<H", head[2:4])[0], struct.unpack("<I", head[8:12])[0]
        blocks = [(address + 16, size)]
        while blocks and left:
            begin, size = blocks.pop(0)
            raw, at = self.read(begin, size), 0
            while at + 8 <= size and left:
                kind, n = struct.unpack("<HH", raw[at : at + 4])
                body = raw[at + 8 : at + 8 + n]
                left -= 1
                if kind == CONTINUATION:
                    blocks.append(struct.unpack("<QQ", body[:16]))
                else:
                    yield kind, body
                at += 8 + n

    def links(self, address: int) -> dict[str, int]:
        """Names and headers of what a group holds; nothing for a dataset."""
        out: dict[str, int] = {}
        for kind, body in self.messages(address):
            if kind == SYMBOLS:
                tree, heap = struct.unpack("<QQ", body[:16])
                names = struct.unpack("<Q", self.read(heap + 24, 8))[0]
                out |= {self.text(names + name): header for name, header in self.symbols(tree)}
            elif kind == LINK:
                flags, at = body[1], 2
                sort = body[at] if flags & 8 else 0
                at += bool(flags & 8) + 8 * bool(flags & 4) + bool(flags & 16)
                width = 1 << (flags & 3)
                n = int.from_bytes(body[at : at + width], "little")
                if sort == 0:
                    out[body[at + width : at + width + n].decode()] = struct.unpack("<Q", body[at + width + n : at + width + n + 8])[0]
            elif kind == LINK_INFO and struct.unpack("<Q", body[2 + 8 * (body[1] & 1) :][:8])[0] != NOWHERE:
                raise TensorError("groups of very many links aren't read")
        return out

    def text(self, at: int) -> str:
        out = b""
        while b"\0" not in out:
            out += self.read(at + len(out), 64)
        return out.split(b"\0")[0].decode()

    def symbols(self, node: int) -> Iterator[tuple[int, int]]:
        head = self.read(node, 24)
        n = struct.unpack("<H", head[6:8])[0]
        if head[:4] == b"TREE":
            raw = self.read(node + 24, 8 + 16 * n)
            for k in range(n):
                yield from self.symbols(struct.unpack("<Q", raw[8 + 16 * k : 16 + 16 * k])[0])
        else:
            raw = self.read(node + 8, 40 * n)
            for k in range(n):
                yield struct.unpack("<QQ", raw[40 * k : 40 * k + 16])

    def datasets(self, address: int | None = None, path: str = "") -> dict[str, int]:
        """Paths and headers of all datasets."""
        found: dict[str, int] = {}
        for name, header in self.links(self.root if address is None else address).items():
            kinds = {kind for kind, _ in self.messages(header)}
            found |= {f"{path}/{name}": header} if LAYOUT in kinds else self.datasets(header, f"{path}/{name}")
        return found

    def dataset(self, address: int) -> Dataset:
        shape, dtype, layout, filters, attributes = (), None, b"", [], {}
        for kind, body in self.messages(address):
            if kind == DATASPACE:
                shape = space(body)
            elif kind == DATATYPE:
                dtype = number(body)
            elif kind == LAYOUT:
                layout = body
            elif kind == FILTERS:
                filters = pipeline(body)
            elif kind == ATTRIBUTE:
                name, value = attribute(body)
                attributes[name] = value
        if dtype is None:
            raise TensorError("only datasets of numbers are read")
        if layout[0] != 3:
            raise TensorError(f"HDF5 layouts of version {layout[0]} aren't read")
        out = Dataset(shape, dtype, attributes, filters=filters)
        if layout[1] == 0:
            out.compact = layout[4 : 4 + struct.unpack("<H", layout[2:4])[0]]
        elif layout[1] == 1:
            out.address = struct.unpack("<Q", layout[2:10])[0]
        else:
            out.address = struct.unpack("<Q", layout[3:11])[0]
            out.chunks = struct.unpack(f"<{layout[2] - 1}I", layout[11 : 11 + 4 * (layout[2] - 1)])
        return out

    def chunk(self, d: Dataset, begin: tuple[int, ...]) -> np.ndarray | None:
        """The whole chunk that starts at ``begin``; None if it was never written."""
        node, rank = d.address, len(d.shape)
        size = 8 + 8 * (rank + 1)
        while node != NOWHERE:
            head = self.read(node, 24)
            level, n = head[5], struct.unpack("<H", head[6:8])[0]
            raw = self.read(node + 24, (size + 8) * n)
            keys = [struct.unpack(f"<II{rank}Q", raw[k * (size + 8) : k * (size + 8) + 8 + 8 * rank]) for k in range(n)]
            at = sum(key[2:] <= begin for key in keys) - 1
            if at < 0 or level == 0 and keys[at][2:] != begin:
                return None
            child = struct.unpack("<Q", raw[at * (size + 8) + size : (at + 1) * (size + 8)])[0]
            if level == 0:
                return np.frombuffer(unfiltered(self.read(child, keys[at][0]), d, keys[at][1]), d.dtype).reshape(d.chunks)
            node = child
        return None

    def box(self, d: Dataset, begin: tuple[int, ...], shape: tuple[int, ...]) -> np.ndarray:
        """A box that lies in one chunk, or any box of a dataset without chunks."""
        if d.chunks is not None:
            first = tuple(b // c * c for b, c in zip(begin, d.chunks, strict=True))
            whole = self.chunk(d, first)
            return np.zeros(shape, d.dtype) if whole is None else whole[tuple(slice(b - f, b - f + n) for b, f, n in zip(begin, first, shape, strict=True))]
        if d.compact is not None:
            return np.frombuffer(d.compact, d.dtype)[: prod(d.shape)].reshape(d.shape)[tuple(slice(b, b + n) for b, n in zip(begin, shape, strict=True))]
        if d.address == NOWHERE:
            return np.zeros(shape, d.dtype)
        # Slices of the first axis, which lie together in the file.
        plane = prod(d.shape[1:]) * d.dtype.itemsize
        rows = np.frombuffer(self.read(d.address + begin[0] * plane, shape[0] * plane), d.dtype).reshape(shape[0], *d.shape[1:])
        return rows[(slice(None), *(slice(b, b + n) for b, n in zip(begin[1:], shape[1:], strict=True)))]


def space(body: bytes) -> tuple[int, ...]:
    begin = 8 if body[0] == 1 else 4
    return struct.unpack(f"<{body[1]}Q", body[begin : begin + 8 * body[1]])


def number(body: bytes) -> np.dtype | None:
    """The numpy type of whole numbers and floats; None for others."""
    kind, bits, size = body[0] & 15, body[1], struct.unpack("<I", body[4:8])[0]
    if kind not in (0, 1):
        return None
    return np.dtype(("<>"[bits & 1]) + ("f" if kind else "iu"[not bits & 8]) + str(size))


def pipeline(body: bytes) -> list[tuple[int, tuple[int, ...]]]:
    old, at, out = body[0] == 1, 8 if body[0] == 1 else 2, []
    for _ in range(body[1]):
        kind = struct.unpack("<H", body[at : at + 2])[0]
        named = old or kind >= 256
        name = struct.unpack("<H", body[at + 2 : at + 4])[0] if named else 0
        at += 4 if named else 2
        n = struct.unpack("<H", body[at + 2 : at + 4])[0]
        at += 4 + (-(-name // 8) * 8 if old else name)
        out.append((kind, struct.unpack(f"<{n}I", body[at : at + 4 * n])))
        at += 4 * n + (4 * (n % 2) if old else 0)
    return out


def attribute(body: bytes) -> tuple[str, object]:
    name, kind, shape = struct.unpack("<HHH", body[2:8])
    pad = (lambda n: -(-n // 8) * 8) if body[0] == 1 else (lambda n: n)
    at = 9 if body[0] == 3 else 8
    text = body[at : at + name].split(b"\0")[0].decode()
    at += pad(name)
    dtype = number(body[at : at + kind])
    at += pad(kind)
    dims = space(body[at : at + shape]) if shape else ()
    at += pad(shape)
    if dtype is None:
        return text, None
    values = np.frombuffer(body[at : at + prod(dims) * dtype.itemsize], dtype)
    return text, values.reshape(dims) if dims else values[0]


def unfiltered(raw: bytes, d: Dataset, skipped: int) -> bytes:
    for k, (kind, _) in reversed(list(enumerate(d.filters))):
        if skipped >> k & 1:
            continue
        if kind == DEFLATE:
            raw = zlib.decompress(raw)
        elif kind == SHUFFLE:
            raw = np.frombuffer(raw, np.uint8).reshape(d.dtype.itemsize, -1).T.tobytes()
        elif kind == CHECKSUM:
            raw = raw[:-4]
        else:
            raise TensorError(f"HDF5 filter {kind} isn't read")
    return raw


# Writing


def _message(kind: int, body: bytes) -> bytes:
    body += bytes(-len(body) % 8)
    return struct.pack("<HHBxxx", kind, len(body), 0) + body


def _header(*messages: bytes) -> bytes:
    return struct.pack("<BxHII4x", 1, len(messages), 1, sum(map(len, messages))) + b"".join(messages)


def _type(dtype: np.dtype) -> bytes:
    size = dtype.itemsize
    if dtype.kind == "f":
        mantissa, exponent = {4: (23, 8), 8: (52, 11)}[size]
        return struct.pack("<BBBBIHHBBBBI", 0x11, 0x20, size * 8 - 1, 0, size, 0, size * 8, mantissa, exponent, 0, mantissa, (1 << exponent - 1) - 1)
    return struct.pack("<BBBBIHH", 0x10, 8 * (dtype.kind == "i"), 0, 0, size, 0, size * 8)


def _space(shape: tuple[int, ...]) -> bytes:
    return struct.pack(f"<BBB5x{len(shape)}Q", 1, len(shape), 0, *shape)


def _attribute(name: str, values: np.ndarray) -> bytes:
    pad = lambda b: b + bytes(-len(b) % 8)
    text, kind, shape = name.encode() + b"\0", _type(values.dtype), _space(values.shape)
    return struct.pack("<BxHHH", 1, len(text), len(kind), len(shape)) + pad(text) + pad(kind) + pad(shape) + values.tobytes()


@dataclass
class Written:
    """A dataset whose chunks lie in the file already: ``places`` maps a chunk's first element to its address and size."""

    name: str
    shape: tuple[int, ...]
    dtype: np.dtype
    chunks: tuple[int, ...]
    places: dict[tuple[int, ...], tuple[int, int]]
    filters: list[tuple[int, tuple[int, ...]]]
    attributes: dict[str, np.ndarray]


def superblock(root: int, tree: int, heap: int, end: int) -> bytes:
    head = SIGNATURE + struct.pack("<BBBxBBBxHHI", 0, 0, 0, 0, 8, 8, LEAF_K, GROUP_K, 0)
    return head + struct.pack("<QQQQ", 0, NOWHERE, end, NOWHERE) + struct.pack("<QQIIQQ", 0, root, 1, 0, tree, heap)


#: Where a file's first object may lie.
BEGIN = 96


def metadata(datasets: list[Written], at: int) -> tuple[bytes, bytes]:
    """``(superblock, rest)``: what goes to the file's begin, and to ``at``, beyond all chunks."""
    if len(datasets) > 2 * LEAF_K:
        raise TensorError("too many datasets for one group")
    out = bytearray()

    def put(raw: bytes) -> int:
        out.extend(bytes(-(at + len(out)) % 8))
        place = at + len(out)
        out.extend(raw)
        return place

    headers = {}
    for d in datasets:
        rank, tree = len(d.shape), NOWHERE
        level, nodes = 0, [((size, 0, *begin, 0), place) for begin, (place, size) in sorted(d.places.items())]
        while nodes and (level == 0 or len(nodes) > 1):
            upper = []
            for k in range(0, len(nodes), 2 * CHUNK_K):
                some = nodes[k : k + 2 * CHUNK_K]
                last = (0, 0, *(s + c for s, c in zip(some[-1][0][2:-1], d.chunks, strict=True)), d.dtype.itemsize)
                body = b"".join(struct.pack(f"<II{rank + 1}QQ", *key, place) for key, place in some) + struct.pack(f"<II{rank + 1}Q", *last)
                whole = (2 * CHUNK_K) * (16 + 8 * (rank + 1)) + 8 + 8 * (rank + 1)
                upper.append((some[0][0], put(b"TREE" + struct.pack("<BBHQQ", 1, level, len(some), NOWHERE, NOWHERE) + body.ljust(whole, b"\0"))))
            nodes, level = upper, level + 1
            tree = nodes[0][1]
        filters = b"".join(struct.pack(f"<HHHH{len(v)}I", kind, 0, 1, len(v), *v) + bytes(4 * (len(v) % 2)) for kind, v in d.filters)
        layout = struct.pack(f"<BBBQ{rank + 1}I", 3, 2, rank + 1, tree, *d.chunks, d.dtype.itemsize)
        messages = [_message(DATASPACE, _space(d.shape)), _message(DATATYPE, _type(d.dtype)), _message(0x05, struct.pack("<BBBB", 2, 3, 0, 0)), _message(LAYOUT, layout)]
        if d.filters:
            messages.append(_message(FILTERS, struct.pack("<BB6x", 1, len(d.filters)) + filters))
        messages += [_message(ATTRIBUTE, _attribute(name, v)) for name, v in d.attributes.items()]
        headers[d.name] = put(_header(*messages))
    names, offsets = bytearray(8), {}
    for name in sorted(headers):
        offsets[name] = len(names)
        raw = name.encode() + b"\0"
        names += raw + bytes(-len(raw) % 8)
    data = put(bytes(names))
    heap = put(b"HEAP" + struct.pack("<B3xQQQ", 0, len(names), 1, data))
    entries = b"".join(struct.pack("<QQII16x", offsets[n], headers[n], 0, 0) for n in sorted(headers))
    leaf = put(b"SNOD" + struct.pack("<BxH", 1, len(headers)) + entries.ljust(40 * 2 * LEAF_K, b"\0"))
    tree = put(b"TREE" + struct.pack("<BBHQQ", 0, 0, 1, NOWHERE, NOWHERE) + struct.pack("<QQQ", 0, leaf, max(offsets.values(), default=0)).ljust(16 * 2 * GROUP_K + 8, b"\0"))
    root = put(_header(_message(SYMBOLS, struct.pack("<QQ", tree, heap))))
    return superblock(root, tree, heap, at + len(out)), bytes(out)
