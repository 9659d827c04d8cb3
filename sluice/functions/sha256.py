"""SHA-256 whose state one task can hand to the next.

``hashlib`` gives no state out. OpenSSL, which Python itself is linked with, keeps it in a public struct (``SHA256_CTX``: eight words, the
count of bits, the block begun), so the bytes of that struct are the state. Nothing of ``ctypes`` is kept in the module, which is
sent to tasks by value."""

from __future__ import annotations

import ctypes
import hashlib

#: Bytes of ``SHA256_CTX``: 8 words of state, 2 of bits, a block of 16, 2 of its fill and the digest's length.
STATE_BYTES = 4 * (8 + 2 + 16 + 2)


def _names():
    try:
        import _hashlib
        yield _hashlib.__file__  # its symbols are looked up in the OpenSSL it is linked with, too
    except (ImportError, AttributeError):
        pass
    yield from ("libcrypto.so.3", "libcrypto.so.1.1")


def _library():
    """OpenSSL's functions; None where there are none."""
    for name in _names():
        try:
            lib = ctypes.CDLL(name)
            lib.SHA256_Init.argtypes = [ctypes.c_char_p]
            lib.SHA256_Update.argtypes = [ctypes.c_char_p, ctypes.c_char_p, ctypes.c_size_t]
            lib.SHA256_Final.argtypes = [ctypes.c_char_p, ctypes.c_char_p]
            return lib
        except (OSError, AttributeError):
            continue
    return None


def available() -> bool:
    """Whether OpenSSL's functions are there and agree with ``hashlib``."""
    if _library() is None:
        return False
    data = bytes(range(251)) * 3
    begun = Sha256().update(data[:100]).state()
    return Sha256(begun).update(data[100:]).hexdigest() == hashlib.sha256(data).hexdigest()


class Sha256:
    """``hashlib.sha256`` that begins with the state another one ended with."""

    def __init__(self, state: bytes | None = None):
        self._lib = _library()
        self._context = ctypes.create_string_buffer(state or b"", STATE_BYTES + 1)
        if state is None:
            self._lib.SHA256_Init(self._context)

    def update(self, data: bytes) -> Sha256:
        self._lib.SHA256_Update(self._context, data, len(data))
        return self

    def state(self) -> bytes:
        return self._context.raw[:STATE_BYTES]

    def hexdigest(self) -> str:
        last, out = ctypes.create_string_buffer(self.state(), STATE_BYTES + 1), ctypes.create_string_buffer(32)
        self._lib.SHA256_Final(out, last)
        return out.raw.hex()
