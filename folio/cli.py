"""Command line: volume ids to archive paths."""

from __future__ import annotations

import argparse
import sys

from folio.functions.ids import path_text


def main(argv: list[str] | None = None) -> int:
    """Prints (or writes with ``-o``) one path per id; ids come as arguments or from a file (``-`` is standard input)."""
    p = argparse.ArgumentParser(prog="folio-paths", description="Archive paths of volume ids.")
    p.add_argument("ids", nargs="*")
    p.add_argument("-f", "--from-file")
    p.add_argument("-s", "--oldstyle", action="store_true", help="pairtree instead of stubbytree paths")
    p.add_argument("-o", "--outfile")
    a = p.parse_args(argv)
    if bool(a.ids) == bool(a.from_file):
        print("give ids or a file of ids, not both", file=sys.stderr)
        return 2
    if a.from_file:
        with sys.stdin if a.from_file == "-" else open(a.from_file, encoding="utf-8") as f:
            a.ids = [line.strip() for line in f if line.strip()]
    text = "".join(path_text(x, "pairtree" if a.oldstyle else "stubbytree") + "\n" for x in a.ids)
    if a.outfile:
        with open(a.outfile, "w", encoding="utf-8") as f:
            f.write(text)
    else:
        print(text, end="")
    return 0


if __name__ == "__main__":
    sys.exit(main())
