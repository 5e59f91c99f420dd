"""Small graph documents as files."""

from __future__ import annotations

import json
from pathlib import Path


def function(address, name, source="DEFAULT", **more):
    return {"entry_point": address, "name": name, "signature": f"int {name}(void)", "is_external": source == "IMPORTED", "source": source} | more


def module(folder: Path, name: str, program: str | None, functions: list, edges: list[tuple]) -> str:
    path = folder / f"{name}.callgraph.json"
    document = {"functions": functions, "edges": [{"caller": a, "callee": b} for a, b in edges]}
    path.write_text(json.dumps(document if program is None else {"program": program} | document))
    return str(path)


def three_modules(folder: Path) -> list[str]:
    """A library whose two ways from OpenShelf to an imported door are equally long, with a cycle; one that seals or only weighs; and the targets, without edges."""
    return [
        module(
            folder, "shelf.dll", "SHELF.DLL", [function("0xa0", "OpenShelf"), function("0xa1", "FindShelf"), function("0xa2", "LockShelf"), function("0xaf", "NtOpenDoor", "IMPORTED")],
            [("0xa0", "0xa1"), ("0xa0", "0xa2"), ("0xa1", "0xaf"), ("0xa2", "0xaf"), ("0xa2", "0xa0")],
        ),
        module(folder, "crate.dll", "CRATE.DLL", [function("0xb0", "PackCrate"), function("0xb1", "ZwSealCrate", "IMPORTED"), function("0xb2", "WeighCrate")], [("0xb0", "0xb1")]),
        module(folder, "ntdll.dll", "NTDLL.DLL", [function("0xc0", "NtOpenDoor"), function("0xc1", "ZwSealCrate"), function("0xc2", "RtlCount")], []),
    ]


def unified(folder: Path, name: str = "unified") -> str:
    """A cycle, two equally long ways to the door, a system call behind it, and a node that stands alone."""
    node = lambda i, program, symbol, layer="library", external=False, source="DEFAULT": {"id": i, "name": symbol, "program": program, "is_external": external, "layer": layer, "source": source}
    shelf = [node(f"SHELF.DLL!{symbol}", "SHELF.DLL", symbol) for symbol in ("OpenShelf", "LockShelf", "FindShelf")]
    door, call = node("NTDLL.DLL!NtOpenDoor", "NTDLL.DLL", "NtOpenDoor"), node("SYSCALL:NtOpenDoor", "SYSCALL", "NtOpenDoor", "syscall", True, "SYSCALL")
    nodes = [*shelf, door, call, node("CRATE.DLL!PackCrate", "CRATE.DLL", "PackCrate", external=True, source="IMPORTED")]
    opens, locks, finds = (n["id"] for n in shelf)
    pairs = [(opens, locks, "direct"), (opens, finds, "direct"), (locks, opens, "direct"), (locks, door["id"], "import"), (finds, door["id"], "import"), (door["id"], call["id"], "syscall")]
    edges = [{"source": a, "target": b, "kind": kind} for a, b, kind in pairs]
    path = folder / f"{name}.callgraph.json"
    path.write_text(json.dumps({"graph": "shelves", "windows": {"build": "1"}, "dlls": [], "layers": {"library": 5, "syscall": 1}, "node_count": len(nodes), "edge_count": len(edges), "nodes": nodes, "edges": edges}))
    return str(path)
