"""A chain handler -> find -> load in each language, written for these tests."""

CHAIN = {
    "web/users.ts": 'export function findById(id: string) {\n  return loadUser(id);\n}\nfunction loadUser(id: string) {\n  return { id };\n}\nexport const handler = (req: Req) => findById(req.id);\n',
    "web/UserList.tsx": 'import React from "react";\nexport function UserAvatar() {\n  return <img />;\n}\nexport const UserCard = () => {\n  return <UserAvatar />;\n};\nexport function UserList({ users }: P) {\n  return <ul>{users.map((u) => <UserCard key={u} />)}</ul>;\n}\n',
    "py/service.py": "import os\nfrom app.db import session\n\n\ndef normalize_user(name):\n    return name.strip()\n\n\ndef handle_request(name):\n    return normalize_user(name)\n",
    "go/users.go": 'package users\n\nimport "fmt"\n\nfunc FindByID(id string) string {\n\treturn loadRow(id)\n}\n\nfunc loadRow(id string) string {\n\treturn id\n}\n\nfunc RenderUser(id string) string {\n\treturn FindByID(id)\n}\n',
    "rs/store.rs": "use std::fmt;\n\nfn load_user(id: &str) -> String {\n    id.to_string()\n}\n\npub fn find_by_id(id: &str) -> String {\n    load_user(id)\n}\n\npub fn render_user(id: &str) -> String {\n    find_by_id(id)\n}\n",
    "java/UserService.java": "package app;\n\nimport java.util.List;\n\npublic class UserService {\n    public String findOne(String id) {\n        return loadOne(id);\n    }\n\n    private String loadOne(String id) {\n        return id;\n    }\n\n    public String renderOne(String id) {\n        return findOne(id);\n    }\n}\n",
    "c/store.c": "#include <stdio.h>\n\nstatic int c_load(int id) {\n    return id;\n}\n\nint c_find(int id) {\n    return c_load(id);\n}\n\nint c_render(int id) {\n    return c_find(id);\n}\n",
    "cpp/store.cpp": "#include <string>\n\nclass CppStore {\npublic:\n    int cppLoad(int id) { return id; }\n    int cppFind(int id) { return cppLoad(id); }\n    int cppRender(int id) { return cppFind(id); }\n};\n",
    "cs/Service.cs": "using System;\n\npublic class CsService {\n    public string CsLoad(string id) { return id; }\n    public string CsFind(string id) { return CsLoad(id); }\n    public string CsRender(string id) { return CsFind(id); }\n}\n",
    "rb/service.rb": 'require "set"\n\nclass RbService\n  def rb_load(id)\n    id\n  end\n\n  def rb_find(id)\n    rb_load(id)\n  end\n\n  def rb_render(id)\n    rb_find(id)\n  end\nend\n',
    "php/Service.php": "<?php\nuse App\\Models\\User;\n\nfunction php_load($id) {\n    return $id;\n}\n\nfunction php_find($id) {\n    return php_load($id);\n}\n\nfunction php_render($id) {\n    return php_find($id);\n}\n",
    "web/users.test.ts": 'import { findById } from "./users";\nexport function testFind() {\n  return findById("1");\n}\n',
}
#: find, and the callers that its impact must hold
IMPACT = {"findById": "handler", "UserCard": "UserList", "normalize_user": "handle_request", "FindByID": "RenderUser", "find_by_id": "render_user", "findOne": "renderOne", "c_find": "c_render", "cppFind": "cppRender", "CsFind": "CsRender", "rb_find": "rb_render", "php_find": "php_render"}


def write(root, files):
    for name, text in files.items():
        file = root / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(text if isinstance(text, bytes) else text.encode())
