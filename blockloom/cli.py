"""Command line: review one pair of files, or answer git's external diff."""

from __future__ import annotations

import argparse
import os
import sys

from . import __version__
from .kernels.review import review
from .options import Options


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="blockloom", description="Semantic review of two versions of a source file.")
    p.add_argument("files", nargs="*", metavar="FILE", help="old and new file; - is standard input")
    p.add_argument("--version", action="version", version=__version__)
    p.add_argument("--old", default="", help="name of the old version; decides its language")
    p.add_argument("--new", default="", help="name of the new version")
    p.add_argument("-B", "--before-contents", default="", help="file with the old contents")
    p.add_argument("-A", "--after-contents", default="", help="file with the new contents")
    for flag, text in (
        ("--summary", "only the summary"),
        ("--skip-unchanged", "leave out unchanged blocks"),
        ("--simple-diff", "one line diff of the whole files"),
        ("--no-color", "no colours"),
        ("--word-diff", "mark changed words"),
        ("--ignore-all-space", "compare lines without space"),
    ):
        p.add_argument(flag, action="store_true", help=text)
    p.add_argument("--added-style", default="white", choices=("white", "green"))
    p.add_argument("--removed-style", default="white", choices=("white", "red"))
    p.add_argument("--word-diff-span-threshold", type=float, default=0.4)
    p.add_argument("--git", action="store_true", help="arguments are those of git's external diff")
    return p


def resolve(a: argparse.Namespace) -> tuple[str, str, str, str]:
    """(old name, new name, old contents' path, new contents' path)."""
    if len(a.files) > 2:
        raise ValueError("at most two files")
    first, second = [*a.files, "", ""][:2]
    old, new = a.old or first, a.new or second
    paths = a.before_contents or first or a.old, a.after_contents or second or a.new
    if not all((old, new)) and not all(paths):
        raise ValueError("two files are needed")
    if all(p in ("", "-") for p in paths):
        raise ValueError("only one side can be standard input")
    return old or "-", new or "-", *paths


def load(path: str) -> str:
    data = sys.stdin.buffer.read() if path in ("", "-") else open(path, "rb").read()
    return data.decode("utf-8", "surrogateescape")


def git_arguments(args: list[str], env) -> list[str] | None:
    """Arguments for a call by git: path old-file old-hex old-mode new-file new-hex new-mode [new-path [info]]."""
    if len(args) < 7:
        return None
    out = ["--old", args[0], "--new", args[7] if len(args) > 7 else args[0], "-B", args[1], "-A", args[4], "--ignore-all-space"]
    out += [] if env.get("BLOCKLOOM_KEEP_UNCHANGED") == "1" else ["--skip-unchanged"]
    out += ["--no-color"] if env.get("NO_COLOR") else []
    out += ["--word-diff"] if env.get("BLOCKLOOM_WORD_DIFF") == "1" else []
    return [*out, "--removed-style", env.get("BLOCKLOOM_REMOVED_STYLE", "red"), "--added-style", env.get("BLOCKLOOM_ADDED_STYLE", "white")]


def main(argv: list[str] | None = None) -> int:
    """0 with or without differences, 1 on an error."""
    argv = sys.argv[1:] if argv is None else argv
    if argv[:1] == ["--git"]:
        if len(argv) == 2:
            print(f"* Unmerged path {argv[1]}")
            return 0
        argv = git_arguments(argv[1:], os.environ)
        if argv is None:
            print("git gives seven arguments or more", file=sys.stderr)
            return 2
    a = parser().parse_args(argv)
    try:
        old_name, new_name, old_path, new_path = resolve(a)
        old, new = load(old_path), load(new_path)
    except (OSError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1
    options = Options(
        a.simple_diff, a.summary, a.skip_unchanged, a.ignore_all_space, a.word_diff, a.word_diff_span_threshold, a.no_color, a.added_style, a.removed_style
    )
    sys.stdout.write(review(old, new, old_name, new_name, options).text())
    return 0


if __name__ == "__main__":
    sys.exit(main())
