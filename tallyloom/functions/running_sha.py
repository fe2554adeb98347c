"""SHA-256 that can be laid aside and taken up again in another task."""

from __future__ import annotations

import ctypes
import hashlib
from functools import cache


class _Context(ctypes.Structure):
    """OpenSSL's SHA256_CTX. ``hashlib`` has no way to hand out the state of a digest; this structure is that state."""

    _fields_ = [
        ("chain", ctypes.c_uint32 * 8),
        ("bits_low", ctypes.c_uint32),
        ("bits_high", ctypes.c_uint32),
        ("data", ctypes.c_uint32 * 16),
        ("held", ctypes.c_uint32),
        ("digest_size", ctypes.c_uint32),
    ]


@cache
def _library() -> ctypes.CDLL:
    """The OpenSSL that ``hashlib`` uses, tried out on a short text."""
    try:
        import _hashlib

        library = ctypes.CDLL(_hashlib.__file__)
        library.SHA256_Init.argtypes = [ctypes.c_void_p]
        library.SHA256_Update.argtypes = [ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t]
        library.SHA256_Final.argtypes = [ctypes.c_char_p, ctypes.c_void_p]
    except (ImportError, AttributeError, OSError) as error:
        raise RuntimeError("files hashed in steps need a Python whose hashlib uses OpenSSL as a shared library") from error
    first = RunningSha256(None, library)
    first.update(b"a" * 100)
    second = RunningSha256(first.state(), library)
    second.update(b"b")
    if second.hexdigest() != hashlib.sha256(b"a" * 100 + b"b").hexdigest():
        raise RuntimeError("the state of this OpenSSL's SHA-256 has another layout")
    return library


class RunningSha256:
    def __init__(self, state: bytes | None = None, library: ctypes.CDLL | None = None):
        self.library = library or _library()
        self.context = _Context()
        if state is None:
            self.library.SHA256_Init(ctypes.byref(self.context))
        else:
            self.context = _Context.from_buffer_copy(state)

    def update(self, data: bytes) -> None:
        self.library.SHA256_Update(ctypes.byref(self.context), data, len(data))

    def state(self) -> bytes:
        return bytes(self.context)

    def hexdigest(self) -> str:
        last, digest = _Context.from_buffer_copy(self.state()), ctypes.create_string_buffer(32)
        self.library.SHA256_Final(digest, ctypes.byref(last))
        return digest.raw.hex()
