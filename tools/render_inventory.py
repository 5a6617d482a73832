"""Render the operator inventory table into README.md (between markers)."""

from __future__ import annotations

import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from terrapanel.inventory import INVENTORY, NAMED_QUERIES  # noqa: E402

BEGIN, END = "<!-- inventory:begin -->", "<!-- inventory:end -->"


def table() -> str:
    rows = ["| id | implementation (`terrapanel.…`) | registered query |", "|---|---|---|"]
    rows += [f"| `{k}` | `{impl}` | `{key}` |" for k, (impl, key) in INVENTORY.items()]
    rows.append("")
    rows.append("Named queries (all registered under their own names): " + ", ".join(f"`{q}`" for q in NAMED_QUERIES))
    return "\n".join(rows)


def main() -> None:
    path = os.path.join(ROOT, "README.md")
    text = open(path, encoding="utf-8").read()
    block = f"{BEGIN}\n{table()}\n{END}"
    if BEGIN in text:
        text = text[: text.index(BEGIN)] + block + text[text.index(END) + len(END):]
    else:
        text = text.rstrip() + "\n\n## Operator inventory\n\n" + block + "\n"
    open(path, "w", encoding="utf-8").write(text)


if __name__ == "__main__":
    main()
