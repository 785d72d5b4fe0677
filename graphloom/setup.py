"""Files that a project starts with, and shell completions."""

from __future__ import annotations

from pathlib import Path

from graphloom.sources.config import CONFIG_NAME

HOOK = '#!/bin/sh\ngraphloom index "$(git rev-parse --show-toplevel)" >/dev/null 2>&1 &\n'
SERVER = '{\n  "mcpServers": {\n    "graphloom": {"command": "graphloom", "args": ["mcp"]}\n  }\n}\n'
FILES = {
    CONFIG_NAME: '[include]\npaths = []\n\n[exclude]\npaths = []\n\n[ignore]\nextra = []\n',
    ".graphloom/agents/desktop.json": SERVER,
    ".graphloom/agents/editor.json": SERVER,
    ".graphloom/agents/terminal.toml": '[mcp_servers.graphloom]\ncommand = "graphloom"\nargs = ["mcp"]\n',
    ".graphloom/hooks/post-commit": HOOK,
    ".graphloom/hooks/post-merge": HOOK,
}


def init(root: str, force: bool = False) -> dict:
    created, skipped = [], []
    for name, text in FILES.items():
        file = Path(root) / name
        if file.exists() and not force:
            skipped.append(name)
            continue
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(text)
        if "/hooks/" in name:
            file.chmod(0o755)
        created.append(name)
    return {"root": str(root), "created": created, "skipped": skipped, "next_steps": [f"graphloom index {root}", "graphloom doctor", "graphloom mcp"]}


def completions(shell: str, commands: list[str]) -> str:
    words = " ".join(commands)
    if shell == "bash":
        return f'complete -W "{words}" graphloom\n'
    if shell == "zsh":
        return f"#compdef graphloom\n_arguments '1:command:({words})' '*::arg:_files'\n"
    if shell == "fish":
        return "".join(f"complete -c graphloom -n __fish_use_subcommand -a {c}\n" for c in commands)
    if shell == "powershell":
        quoted = ", ".join(f"'{c}'" for c in commands)
        return f"Register-ArgumentCompleter -Native -CommandName graphloom -ScriptBlock {{ param($word) @({quoted}) | Where-Object {{ $_ -like \"$word*\" }} }}\n"
    raise ValueError(f"unknown shell: {shell}")
