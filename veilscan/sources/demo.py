"""Two files of made-up data to try a scan on: python -m veilscan.sources.demo FOLDER."""

from __future__ import annotations

import os
import sys

#: By file: lines with a value of some kind each, exposed or masked. Nobody has these numbers.
FILES = {
    "members.txt": ["가상 명단", "900101-1234568 010-1234-5678 first.person@example.com", "900101-1****** 010-****-5678"],
    "contract.txt": ["가상 계약", "02-123-4567 second@example.com", "M12345678", "11-12-345678-90"],
}


def build_demo(folder: str) -> list[str]:
    """Writes the files; returns their paths."""
    os.makedirs(folder, exist_ok=True)
    out = []
    for name, lines in FILES.items():
        out.append(os.path.join(folder, name))
        with open(out[-1], "w", encoding="utf-8") as f:
            f.write("\n".join(lines) + "\n")
    return out


if __name__ == "__main__":
    print(*build_demo(sys.argv[1] if len(sys.argv) > 1 else "demo"), sep="\n")
