"""python -m lakescan.generate FILE [OUT]: schemas of an interface file's structs as Python text, printed or written to OUT."""

from __future__ import annotations

import sys
from pathlib import Path

from lakescan.sources.thrift_idl import IdlError
from lakescan.sources.thrift_schema import source


def main(args: list[str]) -> int:
    if len(args) not in (1, 2):
        print("usage: python -m lakescan.generate FILE [OUT]", file=sys.stderr)
        return 2
    try:
        text = source(Path(args[0]).read_text())
    except (OSError, IdlError) as e:
        print(f"{args[0]}: {e}", file=sys.stderr)
        return 1
    if len(args) == 2:
        Path(args[1]).write_text(text)
    else:
        print(text, end="")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
