"""Source text to blocks: language detection and one scanner per family of languages."""

from __future__ import annotations

from ..kernels.blocks import Document
from .bash import BashScanner
from .cfamily import scan_c
from .common import nesting
from .ecma import EcmaScanner
from .golang import GoScanner

#: Fixed: file name endings and their languages. "h" stands for headers, whose language is settled by reading them.
EXTENSIONS = {
    ".ts": "ts", ".tsx": "tsx", ".js": "js", ".mjs": "js", ".cjs": "js", ".jsx": "jsx", ".go": "go", ".sh": "bash", ".bash": "bash", ".c": "c",
    ".cc": "cpp", ".cpp": "cpp", ".cxx": "cpp", ".c++": "cpp", ".hh": "cpp", ".hpp": "cpp", ".hxx": "cpp", ".h++": "cpp", ".tcc": "cpp", ".h": "cpp",
}
LANGUAGES = sorted(set(EXTENSIONS.values()))


def extension(name: str) -> str:
    base = name.rsplit("/", 1)[-1]
    return base[base.rfind(".") :] if "." in base else ""


def detect(name: str) -> str | None:
    """Language by file name; .C is C++, other endings are read without case; None if unknown."""
    ext = extension(name)
    return "cpp" if ext == ".C" else EXTENSIONS.get(ext.lower())


def extract(src: str, language: str, macros: bool = False) -> Document:
    """Blocks of a Latin-1 text of raw bytes. `macros`: function-like macros are a kind of their own."""
    with nesting(src):
        if language in ("ts", "tsx", "js", "jsx"):
            return EcmaScanner(src, language).document()
        if language == "go":
            return GoScanner(src).document()
        if language == "bash":
            return BashScanner(src).document()
        if language in ("c", "cpp", "h"):
            return scan_c(src, language, macros)
        raise ValueError(f"no scanner for {language}")
