"""Small HDF5 files of several layouts, put together byte by byte, for tests of the reader."""

import struct
import zlib

import numpy as np

NOWHERE = 0xFFFFFFFFFFFFFFFF


def datatype(dtype):
    dtype = np.dtype(dtype)
    order = int(dtype.byteorder == ">")
    if dtype.kind == "f":
        e, m, bias = {4: (8, 23, 127), 8: (11, 52, 1023)}[dtype.itemsize]
        bits = 8 * dtype.itemsize
        return struct.pack("<BBBBIHHBBBBI", 0x11, 0x20 | order, bits - 1, 0, dtype.itemsize, 0, bits, m, e, 0, m, bias)
    return struct.pack("<BBBBIHH", 0x10, order | (8 if dtype.kind == "i" else 0), 0, 0, dtype.itemsize, 0, 8 * dtype.itemsize)


def dataspace(shape, version=1):
    head = struct.pack("<BBB5x", 1, len(shape), 0) if version == 1 else struct.pack("<BBBB", 2, len(shape), 0, int(len(shape) > 0))
    return head + struct.pack(f"<{len(shape)}Q", *shape)


def attribute(name, values, version=1):
    values = np.asarray(values, "<f8")
    raw, parts = name.encode() + b"\0", [datatype(values.dtype), dataspace(values.shape, 1 if version == 1 else 2)]
    pad = (lambda b: b + b"\0" * (-len(b) % 8)) if version == 1 else (lambda b: b)
    head = struct.pack("<BBHHH", version, 0, len(raw), *map(len, parts)) + (b"\0" if version == 3 else b"")
    return head + pad(raw) + b"".join(map(pad, parts)) + values.tobytes()


def message(kind, content):
    content += b"\0" * (-len(content) % 8)
    return struct.pack("<HHB3x", kind, len(content), 0) + content


def old_object(*messages, split=False):
    """A header of version 1; ``split`` leaves all but the first message to a continuation, which the caller places behind it."""
    body = b"".join(messages)
    return struct.pack("<BxHII4x", 1, len(messages), 1, len(body)) + body


def new_object(*messages):
    body = b"".join(struct.pack("<BHB", kind, len(content), 0) + content for kind, content in messages)
    return b"OHDR" + struct.pack("<BBI", 2, 2, len(body)) + body + b"\0" * 4


class File:
    def __init__(self, size):
        self.raw = bytearray(size)

    def add(self, content):
        at = len(self.raw)
        self.raw += content + b"\0" * (-len(content) % 8)
        return at

    def put(self, at, content):
        self.raw[at : at + len(content)] = content


def packed(chunk, filters):
    raw = chunk.tobytes()
    for f in filters:
        if f == 2:
            raw = np.frombuffer(raw, np.uint8).reshape(-1, chunk.itemsize).T.tobytes()
        elif f == 1:
            raw = zlib.compress(raw)
        elif f == 3:
            raw += b"sum!"
    return raw


def chunks_of(array, chunk, skip=()):
    """Places of the grid of chunks and whole chunks (edge ones filled with 99)."""
    for at in np.ndindex(*[-(-n // c) for n, c in zip(array.shape, chunk)]):
        if at in skip:
            continue
        part = array[tuple(slice(a * c, (a + 1) * c) for a, c in zip(at, chunk))]
        yield at, np.pad(part, [(0, c - n) for c, n in zip(chunk, part.shape)], constant_values=99)


def filter_message(filters, width):
    out = struct.pack("<BB6x", 1, len(filters))
    for f in filters:
        values = {1: [6], 2: [width], 3: []}[f]
        out += struct.pack("<HHHH", f, 8, 0, len(values)) + b"filter\0\0" + struct.pack(f"<{len(values)}I", *values) + b"\0" * (4 * (len(values) % 2))
    return out


def btree(file, entries, rank, per_node=3):
    """A chunk index with few entries a node, so that it has several levels. Entries: (stored size, offsets, address)."""
    level = 0
    while True:
        nodes = []
        for k in range(0, len(entries), per_node):
            part = entries[k : k + per_node]
            raw = b"TREE" + struct.pack("<BBHQQ", 1, level, len(part), NOWHERE, NOWHERE)
            for size, offsets, there in part:
                raw += struct.pack(f"<II{rank}QQQ", size, 0, *offsets, 0, there)
            raw += struct.pack(f"<II{rank}QQ", 0, 0, *[1 << 40] * rank, 0)
            nodes.append((part[0][0], part[0][1], file.add(raw)))
        if len(nodes) == 1:
            return nodes[0][2]
        entries, level = nodes, level + 1


def old_file(path, arrays, root_attributes=(), userblock=0):
    """Superblock 0, a symbol table, and for each name (array, chunk or None, filters, attributes, skipped chunks, fill)."""
    file = File(96)
    objects = {}
    for name, (array, chunk, filters, attributes, skip, fill) in arrays.items():
        width = array.itemsize
        if chunk:
            entries = [(len(raw := packed(c, filters)), [a * n for a, n in zip(at, chunk)], file.add(raw)) for at, c in chunks_of(array, chunk, skip)]
            tree = btree(file, entries, array.ndim) if entries else NOWHERE
            layout = struct.pack(f"<BBBQ{array.ndim + 1}I", 3, 2, array.ndim + 1, tree, *chunk, width)
        elif array.nbytes <= 64:
            layout = struct.pack("<BBH", 3, 0, array.nbytes) + array.tobytes()
        else:
            layout = struct.pack("<BBQQ", 3, 1, file.add(array.tobytes()), array.nbytes)
        fill_message = struct.pack("<BBBB", 2, 2, 2, 1) + struct.pack("<I", width if fill is not None else 0) + (np.array(fill, array.dtype).tobytes() if fill is not None else b"")
        messages = [message(1, dataspace(array.shape)), message(3, datatype(array.dtype)), message(5, fill_message)]
        messages += [message(0xB, filter_message(filters, width))] if filters else []
        # The rest stands in a continuation.
        rest = b"".join([message(8, layout), *[message(0xC, attribute(k, v)) for k, v in attributes.items()]])
        there = file.add(rest)
        objects[name] = file.add(old_object(*messages, message(0x10, struct.pack("<QQ", there, len(rest)))))
    heap, offsets = b"\0" * 8, {}
    for name in sorted(objects):
        offsets[name] = len(heap)
        heap += name.encode() + b"\0" * (8 - len(name) % 8)
    tables = []
    names = sorted(objects)
    for k in range(0, len(names), 2):
        part = names[k : k + 2]
        tables.append((file.add(b"SNOD" + struct.pack("<BxH", 1, len(part)) + b"".join(struct.pack("<QQII16x", offsets[n], objects[n], 0, 0) for n in part)), offsets[part[-1]]))
    tree = file.add(b"TREE" + struct.pack("<BBHQQ", 0, 0, len(tables), NOWHERE, NOWHERE) + struct.pack("<Q", 0) + b"".join(struct.pack("<QQ", *t) for t in tables))
    segment = file.add(heap)
    heap_at = file.add(b"HEAP" + struct.pack("<B3xQQQ", 0, len(heap), 1, segment))
    root = file.add(old_object(message(0x11, struct.pack("<QQ", tree, heap_at)), *[message(0xC, attribute(k, v)) for k, v in root_attributes]))
    head = b"\x89HDF\r\n\x1a\n" + struct.pack("<8BHHI", 0, 0, 0, 0, 0, 8, 8, 0, 4, 16, 0)
    file.put(0, head + struct.pack("<QQQQ", userblock, NOWHERE, len(file.raw), NOWHERE) + struct.pack("<QQII16x", 0, root, 0, 0))
    path.write_bytes(b"#" * userblock + bytes(file.raw))
    return str(path)


def new_file(path, name, array, chunk, index, filters=(), page_bits=10, skip=()):
    """Superblock 2, links in the header, layout 4 with an index of kind single, implicit or fixed."""
    file = File(48)
    stored = [packed(c, filters) for _, c in chunks_of(array, chunk)]
    keep = [at not in skip for at, _ in chunks_of(array, chunk)]
    head = struct.pack(f"<BBBBB{array.ndim + 1}I", 4, 2, 2 * bool(filters and index == "single"), array.ndim + 1, 4, *chunk, array.itemsize)
    if index == "single":
        layout = head + b"\x01" + (struct.pack("<QI", len(stored[0]), 0) if filters else b"") + struct.pack("<Q", file.add(stored[0]))
    elif index == "implicit":
        layout = head + b"\x02" + struct.pack("<Q", file.add(b"".join(stored)))
    else:
        places = [file.add(raw) if k else NOWHERE for raw, k in zip(stored, keep)]
        entry = [struct.pack("<QII", p, len(raw), 0) if filters else struct.pack("<Q", p) for p, raw in zip(places, stored)]
        per_page, start = 1 << page_bits, b"FADB" + struct.pack("<BBQ", 0, bool(filters), 0)
        if len(entry) > per_page:
            pages = [b"".join(entry[k : k + per_page]).ljust(per_page * len(entry[0]), b"\0") + b"\0" * 4 for k in range(0, len(entry), per_page)]
            bits = np.packbits(np.ones(len(pages), np.uint8)).tobytes()
            block = file.add(start + bits + b"\0" * 4 + b"".join(pages))
        else:
            block = file.add(start + b"".join(entry) + b"\0" * 4)
        layout = head + struct.pack("<BB", 3, page_bits) + struct.pack("<Q", file.add(b"FAHD" + struct.pack("<BBBBQQ", 0, bool(filters), len(entry[0]), page_bits, len(entry), block) + b"\0" * 4))
    pipeline = struct.pack("<BB", 2, len(filters)) + b"".join(struct.pack("<HHH", f, 0, 1) + struct.pack("<I", array.itemsize) for f in filters)
    messages = [(1, dataspace(array.shape, 2)), (3, datatype(array.dtype)), (5, struct.pack("<BB", 3, 2)), (8, layout), (0xC, attribute("dx", 0.25, 3))]
    data = file.add(new_object(*messages, *([(0xB, pipeline)] if filters else [])))
    link = struct.pack("<BBB", 1, 0, len(name)) + name.encode() + struct.pack("<Q", data)
    root = file.add(new_object((2, struct.pack("<BBQQ", 0, 0, NOWHERE, NOWHERE)), (6, link)))
    file.put(0, b"\x89HDF\r\n\x1a\n" + struct.pack("<BBBBQQQQ", 2, 8, 8, 0, 0, NOWHERE, len(file.raw), root))
    path.write_bytes(bytes(file.raw))
    return str(path)
