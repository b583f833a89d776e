"""Panels and blocks as packed integers: each column has a step of its own and as many bits a number as its largest needs."""

from __future__ import annotations

import numpy as np

from . import lowrank


def pack(m: np.ndarray, steps: np.ndarray) -> bytes:
    """Columns of a real array as multiples of their steps (0: a column of zeros); what is read back differs by at most half a step."""
    head, body = [np.array(m.shape, np.int64).tobytes()], []
    for x, step in zip(m.T, steps, strict=True):
        q = np.rint(x / step).astype(np.int64) if step > 0 else np.zeros(len(x), np.int64)
        u = (q << 1) ^ (q >> 63)  # the sign in the lowest bit
        width = int(u.max(initial=0)).bit_length()
        head.append(np.array([step], np.float64).tobytes() + bytes([width]))
        body.append(np.packbits(((u[:, None] >> np.arange(width)) & 1).astype(np.uint8)).tobytes())
    return b"".join(head + body)


def unpack(data: bytes) -> np.ndarray:
    n, k = np.frombuffer(data, np.int64, 2)
    out, at = np.zeros((n, k)), 16 + 9 * k
    for j in range(k):
        step, width = np.frombuffer(data, np.float64, 1, 16 + 9 * j)[0], data[16 + 9 * j + 8]
        size = -(-n * width // 8)
        bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=int(n * width)).reshape(n, width)
        u = (bits.astype(np.int64) << np.arange(width)).sum(1)
        out[:, j] = ((u >> 1) ^ -(u & 1)) * step
        at += size
    return out


def _reals(m: np.ndarray) -> np.ndarray:
    """Real and imaginary parts side by side."""
    return np.concatenate([m.real, m.imag], axis=1) if np.iscomplexobj(m) else m


def panels(v: lowrank.Rk, eps: float) -> tuple[bytes, bytes]:
    """Both panels of a low-rank block, so that it moves by at most eps times its largest singular value.

    The panels are made orthogonal first, column p having norms of product s_p; a column may then lose eps s_1 / (2 sqrt(rank) s_p)
    of itself on each side, so columns of small s_p take few bits.
    """
    a, b = lowrank.truncate(v, 0.0)
    out = []
    for m in (a, b):
        n, k = m.shape
        size = np.linalg.norm(m, axis=0)
        weight = np.linalg.norm(a, axis=0) * np.linalg.norm(b, axis=0)
        allowed = np.minimum(eps * weight.max(initial=0) / (2 * np.sqrt(max(1, k)) * np.where(weight > 0, weight, 1)), 1)
        # n entries, each off by half a step (of complex numbers both parts)
        step = 2 * allowed * size / np.sqrt(max(1, n) * (2 if np.iscomplexobj(m) else 1))
        out.append(pack(_reals(m), np.concatenate([step, step]) if np.iscomplexobj(m) else step))
    return out[0], out[1]


def block(m: np.ndarray, eps: float) -> bytes:
    """A dense block, so that its Frobenius norm moves by at most eps of itself."""
    r = _reals(m)
    return pack(r, np.full(r.shape[1], 2 * eps * np.linalg.norm(m) / np.sqrt(max(1, r.size))))


def numbers(data: bytes, complex_: bool) -> np.ndarray:
    m = unpack(data)
    return m[:, : m.shape[1] // 2] + 1j * m[:, m.shape[1] // 2 :] if complex_ else m
