"""Media columns: payloads kept in baseline JPEG and read back.

A payload byte ``b`` is stored as the quantised coefficient ``b - 128`` of a three-component, unsubsampled
baseline JPEG, in zigzag order: one MCU (Y, Cb, Cr block) holds 192 bytes. Coefficients are entropy coded
without loss, so the format's own unit carries the payload exactly. Every MCU is a restart interval; the
decoder therefore steps through all intervals of many pictures at once with numpy.

``read_media`` parses markers, Huffman-decodes the scan, rebuilds the DC-only luminance thumbnail and hashes it.
It takes any baseline JPEG (1 or 3 components, sampling factors, with or without restart markers); progressive
or damaged files give a row with ``error`` set and null features.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modlake.llm.common import text_or_empty

UNIT = 192
#: MCUs that are packed or unpacked at once: bounds the memory of a task whatever a text's length.
CHUNK_MCUS = 4096
#: Bytes of media in one output batch.
BATCH_BYTES = 8 << 20
QUANT = 8


def _canonical(lengths: list[tuple[int, int]]) -> tuple[bytes, dict[int, tuple[int, int]]]:
    """(symbol, length) sorted by length -> DHT body and symbol -> (code, length)."""
    counts, codes, code, last = [0] * 17, {}, 0, 0
    for sym, n in lengths:
        code <<= n - last
        codes[sym], last = (code, n), n
        code += 1
        counts[n] += 1
    return bytes(counts[1:]) + bytes(s for s, _ in lengths), codes


_SHORT = list(range(1, 9))
_LONG = [0x00, 0xF0] + [r << 4 | s for r in range(16) for s in range(1, 11) if not (r == 0 and s <= 8)]
DC_BODY, DC_CODES = _canonical([(s, 4) for s in range(12)])
AC_BODY, AC_CODES = _canonical([(s, 4) for s in _SHORT] + [(s, 9) for s in _LONG])


def _value_bits() -> tuple[np.ndarray, np.ndarray]:
    v = np.arange(256, dtype=np.int64) - 128
    size = np.array([int(abs(x)).bit_length() for x in v], np.int64)
    return size, np.where(v >= 0, v, v + (1 << size) - 1).astype(np.uint64)


_SIZE, _BITS = _value_bits()


def _slot_tables() -> tuple[np.ndarray, ...]:
    """By byte: DC slot bits and length; by run and byte: AC slot bits and length (ZRL codes included)."""
    dc, dcn = np.zeros(256, np.uint64), np.zeros(256, np.int64)
    ac, acn = np.zeros((64, 256), np.uint64), np.zeros((64, 256), np.int64)
    zrl, zrl_n = AC_CODES[0xF0]
    for b in range(256):
        s, bits = int(_SIZE[b]), int(_BITS[b])
        c, n = DC_CODES[s]
        dc[b], dcn[b] = c << s | bits, n + s
        if s:
            for run in range(63):
                word, length = 0, 0
                for _ in range(run // 16):
                    word, length = word << zrl_n | zrl, length + zrl_n
                c, n = AC_CODES[(run % 16) << 4 | s]
                ac[run, b], acn[run, b] = (word << n | c) << s | bits, length + n + s
    return dc, dcn, ac, acn


_DC, _DCN, _AC, _ACN = _slot_tables()


def pack_mcus(mcus: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 192) bytes -> entropy-coded bytes of each MCU (padded with ones, not yet stuffed), and their lengths."""
    n = len(mcus)
    blocks = mcus.reshape(n * 3, 64)
    bits, lens = np.zeros((n, 196), np.uint64), np.zeros((n, 196), np.int64)
    b3, l3 = bits[:, :195].reshape(n, 3, 65), lens[:, :195].reshape(n, 3, 65)
    sb, sl = _AC[0][blocks], _ACN[0][blocks]
    sb[:, 0], sl[:, 0] = _DC[blocks[:, 0]], _DCN[blocks[:, 0]]
    eob_b, eob_l = np.zeros(n * 3, np.uint64), np.zeros(n * 3, np.int64)
    holes = np.flatnonzero((blocks[:, 1:] == 128).any(1))
    if len(holes):
        sub, run = blocks[holes], np.zeros(len(holes), np.int64)
        for k in range(1, 64):
            v = sub[:, k]
            sb[holes, k], sl[holes, k] = _AC[run, v], _ACN[run, v]
            run = np.where(v == 128, run + 1, 0)
        code, length = AC_CODES[0]
        eob_b[holes[run > 0]], eob_l[holes[run > 0]] = code, length
    b3[:, :, :64], l3[:, :, :64] = sb.reshape(n, 3, 64), sl.reshape(n, 3, 64)
    b3[:, :, 64], l3[:, :, 64] = eob_b.reshape(n, 3), eob_l.reshape(n, 3)
    pad = -lens.sum(1) % 8
    bits[:, 195], lens[:, 195] = (1 << pad) - 1, pad
    sizes = lens.sum(1) // 8
    flat_b, flat_l = bits.ravel(), lens.ravel()
    full = flat_l > 0
    flat_b, flat_l = flat_b[full], flat_l[full]
    ends = np.cumsum(flat_l)
    starts = ends - flat_l
    word, room = starts >> 6, 64 - (starts & 63)
    over = flat_l - room
    hi = np.where(over > 0, flat_b >> np.maximum(over, 0).astype(np.uint64), flat_b << np.maximum(-over, 0).astype(np.uint64))
    heads = np.flatnonzero(np.diff(word, prepend=-1))
    words = np.zeros(int(ends[-1] >> 6) + 2, np.uint64)
    words[word[heads]] = np.bitwise_or.reduceat(hi, heads)
    cut = np.flatnonzero(over > 0)
    words[word[cut] + 1] |= flat_b[cut] << (64 - over[cut]).astype(np.uint64)
    return words.astype(">u8").view(np.uint8)[: int(sizes.sum())], sizes


def _shape(n: int) -> tuple[int, int]:
    """MCUs across and down for n MCUs: without filler while one row would do, else near a square with a part of a row as filler."""
    if n <= 8191:
        h = next(d for d in range(int(n**0.5), 0, -1) if n % d == 0)
        return n // h, h
    w = int(np.ceil(np.sqrt(n)))
    return w, -(-n // w)


def _seg(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _head(w: int, h: int, n_bytes: int) -> bytes:
    comps = b"".join(bytes((c, 0x11, 0)) for c in (1, 2, 3))
    return b"".join((
        b"\xff\xd8", _seg(0xFE, struct.pack(">Q", n_bytes)), _seg(0xDB, b"\0" + bytes([QUANT] * 64)),
        _seg(0xC0, struct.pack(">BHHB", 8, h * 8, w * 8, 3) + comps), _seg(0xC4, b"\x00" + DC_BODY), _seg(0xC4, b"\x10" + AC_BODY),
        _seg(0xDD, struct.pack(">H", 1)), _seg(0xDA, b"\x03" + b"".join(bytes((c, 0)) for c in (1, 2, 3)) + b"\x00\x3f\x00"),
    ))


def payload_of(data: bytes) -> bytes:
    """``data`` padded with spaces to a positive multiple of 192."""
    return data + b" " * (UNIT - len(data) if not data else -len(data) % UNIT)


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """Payloads (positive multiples of 192 bytes) -> baseline JPEG files."""
    shapes = [_shape(len(p) // UNIT) for p in payloads]
    padded = [p + b"\x80" * (w * h * UNIT - len(p)) for p, (w, h) in zip(payloads, shapes, strict=True)]
    flat = np.frombuffer(b"".join(padded), np.uint8).reshape(-1, UNIT)
    counts = np.array([w * h for w, h in shapes])
    first = np.cumsum(counts) - counts
    within = np.arange(len(flat)) - np.repeat(first, counts)
    doc = np.repeat(np.arange(len(payloads)), counts)
    scans: list[list[bytes]] = [[] for _ in payloads]
    for at in range(0, len(flat), CHUNK_MCUS):
        raw, sizes = pack_mcus(flat[at : at + CHUNK_MCUS])
        idx, owner = within[at : at + CHUNK_MCUS], doc[at : at + CHUNK_MCUS]
        ff = raw == 255
        mcu = np.repeat(np.arange(len(sizes)), sizes)
        marks = np.cumsum(idx > 0)  # restart markers up to and with the one before this MCU
        dest = np.arange(len(raw)) + np.cumsum(ff) - ff + 2 * marks[mcu]
        out = np.zeros(int(dest[-1]) + 1 + int(ff[-1]), np.uint8)
        out[dest] = raw
        lead = dest[np.cumsum(sizes) - sizes]
        later = np.flatnonzero(idx > 0)
        out[lead[later] - 2], out[lead[later] - 1] = 255, 0xD0 + (idx[later] - 1) % 8
        begin = lead - 2 * (idx > 0)
        cuts = np.flatnonzero(np.diff(owner, prepend=-1))
        edges = [*begin[cuts].tolist(), len(out)]
        for i, c in enumerate(cuts):
            scans[owner[c]].append(out[edges[i] : edges[i + 1]].tobytes())
    return [_head(w, h, len(p)) + b"".join(s) + b"\xff\xd9" for p, (w, h), s in zip(payloads, shapes, scans, strict=True)]


def _lut(body: bytes) -> np.ndarray:
    """16-bit window -> length << 8 | symbol; 0 where no code begins so."""
    out, code, at = np.zeros(65536, np.int64), 0, 16
    for n in range(1, 17):
        for _ in range(body[n - 1]):
            out[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | body[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


def parse(data: bytes) -> dict:
    """Markers of a baseline JPEG up to its scan. ValueError for anything else."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no SOI")
    at, got = 2, {"dht": {}, "dqt": {}, "dri": 0, "note": b""}
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("broken marker")
        kind, (size,) = data[at + 1], struct.unpack_from(">H", data, at + 2)
        body = data[at + 4 : at + 2 + size]
        if kind == 0xDB:
            while body:
                wide = body[0] >> 4
                got["dqt"][body[0] & 15] = struct.unpack(">64H", body[1:129]) if wide else tuple(body[1:65])
                body = body[129 if wide else 65 :]
        elif kind == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                got["dht"][body[0]], body = bytes(body[1:n]), body[n:]
        elif kind == 0xC0:
            bits, got["h"], got["w"], n = struct.unpack_from(">BHHB", body)
            if bits != 8 or n not in (1, 3) or not got["h"] or not got["w"]:
                raise ValueError("not 8-bit baseline with 1 or 3 components")
            got["comps"] = {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)}
        elif 0xC1 <= kind <= 0xCF and kind != 0xC8:
            raise ValueError("not baseline")
        elif kind == 0xDD:
            (got["dri"],) = struct.unpack(">H", body)
        elif kind == 0xFE:
            got["note"] = body
        elif kind == 0xDA:
            if body[0] != len(got.get("comps", ())):
                raise ValueError("scan without all components")
            got["scan"] = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(body[0])]
            end = data.rfind(b"\xff\xd9")
            got["data"] = data[at + 2 + size : end if end >= 0 else len(data)]
            break
        at += 2 + size
    comps = got["comps"]
    one = len(comps) == 1
    hm, vm = (1, 1) if one else (max(c[0] for c in comps.values()), max(c[1] for c in comps.values()))
    got["across"], got["down"] = -(-got["w"] // (8 * hm)), -(-got["h"] // (8 * vm))
    got["plan"] = [(i, *tables) for i, (c, t) in enumerate(got["scan"]) for tables in [(t >> 4, t & 15)] for _ in range(1 if one else comps[c][0] * comps[c][1])]
    got["luma"] = (1, 1) if one else comps[got["scan"][0][0]][:2]
    got["key"] = (tuple(got["plan"]), tuple(sorted(got["dht"].items())))
    return got


def _clean(scan: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A scan without stuffing and restart markers, and where its intervals begin."""
    ff = np.flatnonzero(scan[:-1] == 255) if len(scan) > 1 else np.zeros(0, np.int64)
    after = scan[ff + 1]
    keep = np.ones(len(scan), bool)
    keep[ff[after == 0] + 1] = False
    rst = ff[(after & 0xF8) == 0xD0]
    keep[rst] = keep[rst + 1] = False
    kept = np.cumsum(keep)
    return scan[keep], np.concatenate(([0], kept[rst]))


def _in_step(win, limit, luts, tdc, tac, pos, left, blk, out, mask, per):
    """Decode intervals while all are at the same coefficient: one that meets a zero leaves, and its state is returned."""
    gone: list[tuple] = []
    b = k = 0
    while len(pos):
        table = luts[tdc[b % per] if k == 0 else tac[b % per]]
        byte = pos >> 3
        if byte.max() > limit:
            raise ValueError("scan ends early")
        w, bit = win[byte], pos & 7
        v = table[w >> (24 - bit) & 0xFFFF]
        sym = v & 255
        plain = sym <= 15 if k == 0 else (sym <= 15) & (sym > 0)
        plain &= v > 0
        if not plain.all():
            odd = ~plain
            n = int(odd.sum())
            gone.append((pos[odd], left[odd], blk[odd], np.full(n, b), np.full(n, k)))
            pos, left, blk, w, bit, v, sym = (x[plain] for x in (pos, left, blk, w, bit, v, sym))
        used = (v >> 8) + sym
        most = mask[sym]
        bits = w >> (40 - bit - used) & most
        bits[bits * 2 <= most] -= most[bits * 2 <= most]
        out[blk * 64 + (b * 64 + k)] = bits
        pos = pos + used
        k += 1
        if k == 64:
            k, b = 0, b + 1
            if not (stay := left > b).all():
                pos, left, blk = pos[stay], left[stay], blk[stay]
    empty = np.zeros(0, np.int64)
    return tuple(map(np.concatenate, zip(*gone, strict=True))) if gone else (empty,) * 5


def decode_group(pics: list[dict]) -> list[np.ndarray]:
    """Quantised coefficients, (blocks, 64) in zigzag and MCU order, of pictures with the same tables and plan."""
    plan, dht = pics[0]["plan"], pics[0]["dht"]
    per = len(plan)
    ids = sorted({t for _, d, a in plan for t in (d, 16 + a)})
    luts = np.stack([_lut(dht[t]) for t in ids])
    tdc = np.array([ids.index(d) for _, d, _ in plan])
    tac = np.array([ids.index(16 + a) for _, _, a in plan])
    datas, starts, todo, base, done = [], [], [], [], 0
    for p in pics:
        data, begin = _clean(np.frombuffer(p["data"], np.uint8))
        mcus = p["across"] * p["down"]
        step = p["dri"] or mcus
        need = -(-mcus // step)
        if len(begin) != need:
            raise ValueError("restart markers don't fit")
        starts.append(begin + done)
        done += len(data)
        datas.append(data)
        todo.append(np.minimum(step, mcus - step * np.arange(need)) * per)
        base.append(mcus * per)
    flat = np.concatenate([*datas, np.zeros(8, np.uint8)]).astype(np.uint64)
    win = flat[:-4] << np.uint64(32) | flat[1:-3] << np.uint64(24) | flat[2:-2] << np.uint64(16) | flat[3:-1] << np.uint64(8) | flat[4:]
    win = win.astype(np.int64)
    limit = len(win) - 1
    pos, left = np.concatenate(starts) * 8, np.concatenate(todo)
    blk = np.cumsum(left) - left
    coefs = np.zeros((int(left.sum()), 64), np.int16)
    intervals = blk.copy(), left.copy()
    out = coefs.ravel()
    mask = (1 << np.arange(17)) - 1
    pos, left, blk, b, k = _in_step(win, limit, luts, tdc, tac, pos, left, blk, out, mask, per)
    while len(pos):
        kind = b % per
        t = np.where(k == 0, tdc[kind], tac[kind])
        byte = pos >> 3
        if byte.max() > limit:
            raise ValueError("scan ends early")
        v = luts[t, win[byte] >> (24 - (pos & 7)) & 0xFFFF]
        if not v.all():
            raise ValueError("no such code")
        sym, pos = v & 255, pos + (v >> 8)
        size, run = sym & 15, np.where(k == 0, 0, sym >> 4)
        byte = np.minimum(pos >> 3, limit)
        bits = win[byte] >> (40 - size - (pos & 7)) & mask[size]
        pos = pos + size  # mask[0] is 0: no value
        val = np.where(bits * 2 > mask[size], bits, bits - mask[size])
        at = k + run
        put = size > 0
        if (at[put] > 63).any():
            raise ValueError("too many coefficients")
        if put.all():
            out[(blk + b) * 64 + at] = val
        else:
            out[((blk + b) * 64 + at)[put]] = val[put]
        k = np.where(put | (k == 0) | (run == 15), at + 1, 64)
        if (over := k >= 64).any():
            k, b = np.where(over, 0, k), b + over
            if (stay := b < left).all():
                continue
            pos, left, blk, b, k = pos[stay], left[stay], blk[stay], b[stay], k[stay]
    comp = np.array([c for c, _, _ in plan])
    if per != len(set(comp.tolist())) or (intervals[1] > per).any():  # the DC predictor runs on within an interval
        for first, n in zip(*intervals, strict=True):
            dc = coefs[first : first + n, 0]
            for c in set(comp.tolist()):
                own = np.flatnonzero(np.tile(comp, n // per) == c)
                dc[own] = np.cumsum(dc[own])
    ends = np.cumsum(base)
    return [coefs[e - n : e] for e, n in zip(ends.tolist(), base, strict=True)]


def thumbnail(pic: dict, coefs: np.ndarray) -> np.ndarray:
    """DC-only luminance picture: one pixel for each 8x8 block."""
    hs, vs = pic["luma"]
    per = len(pic["plan"])
    q = pic["dqt"][next(iter(pic["comps"].values()))[2]][0]
    dc = coefs.reshape(-1, per, 64)[:, : hs * vs, 0].astype(np.int64) * q
    grid = dc.reshape(pic["down"], pic["across"], vs, hs).transpose(0, 2, 1, 3).reshape(pic["down"] * vs, pic["across"] * hs)
    return np.clip(np.floor(grid / 8 + 128.5), 0, 255).astype(np.uint8)[: -(-pic["h"] // 8), : -(-pic["w"] // 8)]


def thumb_hash(thumb: np.ndarray) -> str:
    """64-bit difference hash: neighbours in a 8 x 9 sampling of the thumbnail."""
    h, w = thumb.shape
    small = thumb[np.ix_(np.arange(8) * h // 8, np.arange(9) * w // 9)]
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def decode_many(files: list[bytes | None]) -> list[dict]:
    """Files -> dicts with width, height, hash, coefs or with error."""
    out: list[dict] = [{} for _ in files]
    groups: dict[tuple, list[int]] = {}
    pics: dict[int, dict] = {}
    for i, f in enumerate(files):
        try:
            pics[i] = parse(f or b"")
        except (ValueError, IndexError, struct.error, KeyError) as e:
            out[i] = {"error": f"{e}"[:200] or "broken"}
            continue
        groups.setdefault(pics[i]["key"], []).append(i)

    def work(ids: list[int]) -> None:
        try:
            got = decode_group([pics[i] for i in ids])
        except (ValueError, IndexError, KeyError) as e:
            if len(ids) > 1:  # find the broken one
                for i in ids:
                    work([i])
            else:
                out[ids[0]] = {"error": f"{e}"[:200]}
            return
        for i, c in zip(ids, got, strict=True):
            out[i] = {"width": pics[i]["w"], "height": pics[i]["h"], "note": pics[i]["note"], "coefs": c, "hash": thumb_hash(thumbnail(pics[i], c))}

    for ids in groups.values():
        part, size = [], 0
        for i in ids:
            part.append(i)
            size += len(pics[i]["data"])
            if size > CHUNK_MCUS * UNIT:
                work(part)
                part, size = [], 0
        if part:
            work(part)
    return out


def _pieces(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if i > at and total + n > most:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)


def _encode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        col = batch.column(1)
        sizes = pc.binary_length(col).to_pylist()
        for a, z in _pieces(sizes, BATCH_BYTES // 4):
            raw = [x.encode() for x in col.slice(a, z - a).to_pylist()]
            media = encode_many([payload_of(x) for x in raw])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, z - a), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def store_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each whole text as the payload of a baseline JPEG.

    Null texts count as empty; an empty payload is 192 spaces. Repeated rows give repeated rows; other columns
    are left out; an empty table gives an empty one.
    """
    slim = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return slim.mapInArrow(_encode_batches, "doc_id long, n_bytes long, media binary")


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, width int, height int, thumb_hash string, feature string, error string"


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in FEATURES.split(", ")]
    types = {"long": pa.int64(), "string": pa.string(), "int": pa.int32()}
    kinds = [types[x.split()[1]] for x in FEATURES.split(", ")]
    for batch in batches:
        files = batch.column(batch.schema.get_field_index("media"))
        rest = [i for i, n in enumerate(batch.schema.names) if n != "media"]
        rows = []
        for a, z in _pieces([len(x) if x else 0 for x in (y.as_buffer() for y in files)], 2 << 20):
            part = files.slice(a, z - a).to_pylist()
            for f, got in zip(part, decode_many(part), strict=True):
                row = dict.fromkeys(names)
                if f is not None:
                    row |= {"media_bytes": len(f), "media_sha256": hashlib.sha256(f).hexdigest()}
                if "error" in got:
                    row["error"] = got["error"]
                else:
                    row |= {"width": got["width"], "height": got["height"], "thumb_hash": got["hash"], "feature": f"{got['width']}x{got['height']}:{got['hash']}"}
                    if len(got["note"]) == 8:
                        (n,) = struct.unpack(">Q", got["note"])
                        payload = (got["coefs"].ravel() + 128).astype(np.uint8).tobytes()[:n]
                        row |= {"payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-16:])}
                rows.append(row)
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), *(pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True))], [*(batch.schema.names[i] for i in rest), *names])


def read_media(df: DataFrame) -> DataFrame:
    """The columns of ``df`` but ``media``, with what the stored JPEG holds: sizes, digests, dimensions, thumbnail hash.

    Null or damaged media give null features and ``error``.
    """
    rest = df.drop("media")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)
    return df.mapInArrow(_read_batches, f"{schema}, {FEATURES}")
