"""A repository of any size for benchmarks: modules in a ring that all call one helper."""

from __future__ import annotations

from pathlib import Path


def generate(root: str, modules: int = 50) -> int:
    top = Path(root)
    (top / "src").mkdir(parents=True, exist_ok=True)
    (top / "src/shared.ts").write_text("export function commonStep(n: number) {\n  return n + 1;\n}\n")
    for i in range(modules):
        after = (i + 1) % modules
        (top / f"src/part{i}.ts").write_text(
            f'import {{ commonStep }} from "./shared";\nimport {{ run{after} }} from "./part{after}";\n'
            f"export function run{i}(n: number) {{\n  const m = commonStep(n);\n  return m > {modules} ? m : run{after}(m);\n}}\n"
        )
    return modules + 1
