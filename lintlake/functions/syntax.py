"""Plain facts of one Python file, from one walk over its syntax tree.

The only Python code that runs per file. It states what is written where:
bindings, calls with their arguments, assigned strings, callables with a count
of each kind of branch, imported and declared names, how control leaves
statements, and conditions that are constant. What follows from that is
decided by Spark expressions over the rows. The walk keeps its own stack, so a
deeply nested file costs memory, not the file.
"""

from __future__ import annotations

import ast
import hashlib
import re
import warnings
from typing import NamedTuple

NOQA = re.compile(r"#\s*noqa(?::\s*(?P<codes>[A-Z]+\d+(?:[,\s]+[A-Z]+\d+)*))?", re.I)
#: Fields that hold no nodes.
PLAIN_FIELDS = frozenset("ctx op ops id attr arg name names module level asname kind type_comment kwd_attrs rest tag simple conversion is_async".split())


class Watch(NamedTuple):
    """Which facts are wanted, like a filter pushed into a scan: modules and builtins whose calls count, a pattern of assigned names, and whether thresholds need a snippet."""

    modules: frozenset
    builtins: frozenset
    assigned: str
    complexity: int
    positional: int


class Place:
    """Where a node stands."""

    __slots__ = ("scope", "visible", "owners", "branches", "binds", "heard")

    def __init__(self, scope, visible, owners, branches, binds=True, heard=True):
        self.scope, self.visible = scope, visible  # innermost name scope; scopes searched for a name, innermost first
        self.owners = owners  # (kind, name) of the classes and functions around
        self.branches = branches  # counts by kind of the innermost callable
        self.binds, self.heard = binds, heard  # whether stored names count here, whether calls do

    def but(self, **changed):
        return Place(**{**{k: getattr(self, k) for k in self.__slots__}, **changed})


class Flow(NamedTuple):
    """Where control goes from the end of a block: to what follows statement ``after``, if any."""

    after: int | None = None
    shielded: bool = False  # a manager in between may swallow an exception
    loop: int | None = None  # the statement that a break gets behind


def dotted(node) -> str | None:
    """``a.b.c`` for a chain of attributes of a name."""
    names = []
    while type(node) is ast.Attribute:
        names.append(node.attr)
        node = node.value
    if type(node) is not ast.Name:
        return None
    names.append(node.id)
    return ".".join(reversed(names))


def constant(test) -> bool | None:
    """Truth of a condition in three values; None where it depends on the run."""
    values, todo = [], [(test, False)]
    while todo:
        node, ready = todo.pop()
        kind = type(node)
        if kind is ast.Constant:
            values.append(bool(node.value))
        elif kind in (ast.Tuple, ast.List, ast.Set, ast.Dict) and all(type(e) is ast.Constant for e in ast.iter_child_nodes(node) if not isinstance(e, ast.expr_context)):
            values.append(bool(node.keys if kind is ast.Dict else node.elts))
        elif kind is ast.UnaryOp and type(node.op) is ast.Not:
            if ready:
                values.append(None if values[-1] is None else not values.pop())
            else:
                todo += [(node, True), (node.operand, False)]
        elif kind is ast.BoolOp:
            if ready:
                parts = [values.pop() for _ in node.values]
                deciding = type(node.op) is ast.Or
                values.append(deciding if deciding in parts else None if None in parts else not deciding)
            else:
                todo.append((node, True))
                todo += [(v, False) for v in node.values]
        else:
            values.append(None)
    return values[-1]


def shape(node) -> str | None:
    """Hash of a node's structure without positions; None where it is nested too deep to write down."""
    try:
        return hashlib.sha256(ast.dump(node, include_attributes=False).encode("utf-8", "replace")).hexdigest()
    except RecursionError:
        return None


class Reader:
    """One walk over a file."""

    def __init__(self, source: str, watch: Watch) -> None:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            self.tree = ast.parse(source)
        self.lines, self.watch, self.assigned = source.splitlines(), watch, re.compile(watch.assigned)
        self.kinds: list[str] = []  # of the name scopes
        self.bound: list = []  # (scope, name, origin)
        self.called: list = []  # (node, place)
        self.strings: list = []
        self.callables: list = []
        self.declared: list = []  # (kind, name, line, line of the statement, explicit)
        self.tests: list = []  # (line, form, truth, line of the alternative)
        self.used: set[str] = set()
        self.watched: set[str] = set(watch.builtins)
        self.first: dict = {}  # line -> the first node there and its owners
        self.methods: set[int] = set()  # callables directly in a class body
        self.exits: list = []  # per statement: [line of what follows, kind, ways out]
        self.stack: list = []

    # --- scopes and names

    def scope(self, place: Place | None, kind: str, owner=None, branches=None) -> Place:
        visible = tuple(s for s in place.visible if self.kinds[s] != "class") if place else ()
        self.kinds.append(kind)
        here = len(self.kinds) - 1
        return Place(here, (here, *visible), (place.owners if place else ()) + ((owner,) if owner else ()), branches)

    def bind(self, place: Place, name: str, origin: str | None = None) -> None:
        if place.binds:
            self.bound.append((place.scope, name, origin))

    def push(self, nodes, place: Place) -> None:
        self.stack.extend([(n, place) for n in reversed(nodes) if n is not None])

    def rest(self, node, place: Place, skip=()) -> None:
        """Children in the order of their fields."""
        for field in reversed(FIELDS[type(node)]):
            if field not in skip:
                value = getattr(node, field, None)
                if value.__class__ is list:
                    self.stack.extend([(n, place) for n in reversed(value) if n is not None])
                elif value is not None:
                    self.stack.append((value, place))

    # --- nodes

    def on_name(self, node, place):
        if type(node.ctx) is ast.Load:
            self.used.add(node.id)
        else:
            self.bind(place, node.id)
            if type(node.ctx) is ast.Del:
                self.used.add(node.id)

    def on_attribute(self, node, place):
        if type(node.ctx) is ast.Load:
            self.used.add(node.attr)
        self.stack.append((node.value, place))

    def on_import(self, node, place):
        self.imported(node, place, "")

    def on_import_from(self, node, place):
        if node.module == "__future__":
            for alias in node.names:
                self.bind(place, alias.asname or alias.name, f"__future__.{alias.name}")
        else:
            self.imported(node, place, None if node.level else f"{node.module}.")

    def imported(self, node, place, prefix):
        """``prefix`` goes before the imported names: nothing for whole modules, None if the package is not known."""
        for alias in node.names:
            whole = None if prefix is None else prefix + alias.name
            name = alias.asname or alias.name
            if prefix == "" and alias.asname is None:
                name = whole = alias.name.partition(".")[0]
            self.bind(place, name, whole)
            if whole and whole.partition(".")[0] in self.watch.modules:
                self.watched.add(name)
            if alias.asname is not None:
                self.used.add(alias.name)
            if alias.name != "*":
                visible = alias.asname or alias.name.partition(".")[0]
                self.declared.append(("import", visible, alias.lineno, node.lineno, alias.asname == alias.name))
        self.push(node.names, place)

    def on_call(self, node, place):
        if place.heard:
            self.called.append((node, place))
        func = node.func
        if type(func) is ast.Name and func.id in ("getattr", "hasattr") and len(node.args) >= 2:
            match node.args[1]:
                case ast.Constant(value=str(name)):
                    self.used.add(name)
        self.rest(node, place)

    def on_assign(self, node, place):
        self.assigned_string(node, node.targets, place)
        self.exported(node, node.targets)
        self.rest(node, place)

    def on_annotated(self, node, place):
        self.assigned_string(node, [node.target], place)
        self.rest(node, place)

    def on_augmented(self, node, place):
        self.exported(node, [node.target])
        self.rest(node, place)

    def exported(self, node, targets):
        """Names listed in ``__all__`` are used from outside."""
        if any(type(t) is ast.Name and t.id == "__all__" for t in targets) and type(node.value) in (ast.List, ast.Tuple):
            self.used.update(e.value for e in node.value.elts if type(e) is ast.Constant and type(e.value) is str)

    def assigned_string(self, node, targets, place):
        match node.value:
            case ast.Constant(value=str(text)) if place.heard:
                names = []
                for target in targets:
                    match target:
                        case ast.Name(id=name) | ast.Attribute(attr=name):
                            names.append(name)
                        case _:
                            names.append("")
                if any(map(self.assigned.search, names)):
                    self.strings.append((node, names, text, place))

    def on_function(self, node, place):
        self.bind(place, node.name)
        own = self.scope(place, "function", ("f", node.name), {})
        if place.heard:
            self.callables.append((node, place, own, id(node) in self.methods))
        outside = place.but(owners=own.owners, binds=False, branches=None)
        unheard = outside.but(heard=False)
        self.push([*getattr(node, "type_params", ()), node.returns], unheard)
        self.push(node.decorator_list, outside)
        self.push(node.body, own)
        self.parameters(node.args, own, unheard, outside)

    def on_lambda(self, node, place):
        own = self.scope(place, "function", branches=place.branches)
        unheard = place.but(heard=False, binds=False, branches=None)
        self.stack.append((node.body, own))
        self.parameters(node.args, own, unheard, unheard)

    def parameters(self, args, own, annotations, defaults):
        every = [*args.posonlyargs, *args.args, args.vararg, *args.kwonlyargs, args.kwarg]
        for arg in every:
            if arg is not None:
                self.bind(own, arg.arg)
        self.push([*args.kw_defaults, *args.defaults], defaults)
        self.push(every, annotations)

    def on_parameter(self, node, place):
        self.declared.append(("argument", node.arg, node.lineno, node.lineno, False))
        if node.annotation is not None:
            self.stack.append((node.annotation, place))

    def on_class(self, node, place):
        self.bind(place, node.name)
        own = self.scope(place, "class", ("c", node.name))
        outside = place.but(owners=own.owners, binds=False, branches=None)
        self.methods.update(map(id, node.body))
        self.push(node.decorator_list, outside)
        self.push(node.body, own)
        self.push([*getattr(node, "type_params", ()), *node.keywords], outside.but(heard=False))
        self.push(node.bases, outside)

    def on_comprehension(self, node, place):
        own = self.scope(place, "comprehension", branches=place.branches)
        quiet = own.but(binds=False)
        self.count(place, "loop", len(node.generators))
        self.count(place, "filter", sum(len(g.ifs) for g in node.generators))
        for i, part in reversed(list(enumerate(node.generators))):
            self.push(part.ifs, quiet)
            self.stack.append((part.iter, quiet if i else place.but(binds=False)))
            self.stack.append((part.target, own))
        self.push([node.key, node.value] if type(node) is ast.DictComp else [node.elt], quiet)

    def on_match_class(self, node, place):
        self.used.update(node.kwd_attrs)
        self.rest(node, place)

    # --- branches

    def count(self, place, kind, n=1):
        if place.branches is not None and n:
            place.branches[kind] = place.branches.get(kind, 0) + n

    def on_if(self, node, place):
        self.count(place, "if")
        self.test(node, "if")
        self.rest(node, place)

    def on_ternary(self, node, place):
        self.count(place, "ternary")
        self.test(node, "ternary")
        self.rest(node, place)

    def on_while(self, node, place):
        self.test(node, "while")
        self.on_loop(node, place)

    def on_loop(self, node, place):
        self.count(place, "loop")
        self.count(place, "loop_else", bool(node.orelse))
        self.rest(node, place)

    def on_try(self, node, place):
        self.count(place, "handler", len(node.handlers))
        self.count(place, "try_else", bool(node.orelse))
        self.rest(node, place)

    def on_logic(self, node, place):
        self.count(place, "operand", len(node.values) - 1)
        self.rest(node, place)

    def on_match(self, node, place):
        self.count(place, "case", len(node.cases))
        self.count(place, "wildcard", any(type(c.pattern) is ast.MatchAs and c.pattern.pattern is None for c in node.cases))
        self.rest(node, place)

    def on_assert(self, node, place):
        self.count(place, "assert")
        self.rest(node, place.but(branches=None))

    def test(self, node, form):
        truth = constant(node.test)
        if truth is not None:
            other = node.orelse[0] if node.orelse.__class__ is list and node.orelse else node.orelse or None
            self.tests.append((node.lineno, form, truth, other.lineno if other is not None else None))

    def nothing(self, node, place):
        pass

    # --- how control leaves statements

    def flows(self) -> None:
        """Ways out of every statement that something follows.

        A way out ends a block: its first plain exit, else its last statement.
        It is noted at the nearest statement around it that something follows,
        as that is where control would go on.
        """
        todo = [(self.tree.body, Flow())]
        while todo:
            block, flow = todo.pop()
            end = next((i for i, s in enumerate(block) if type(s) in EXITS), len(block) - 1)
            for i, stmt in enumerate(block):
                kind = type(stmt)
                here = flow if i == end else Flow(None, False, flow.loop)
                if kind not in LASTING:
                    if i == end:
                        self.way(flow, "open")
                    continue
                if i + 1 < len(block) and i <= end:
                    self.exits.append([block[i + 1].lineno, KINDS.get(kind, "other"), set()])
                    own = Flow(len(self.exits) - 1, False, flow.loop)
                    targets = (own, here) if i == end and kind in EXITS else (own,)
                else:
                    targets = (here,)
                if kind in EXITS:
                    for t in targets:
                        self.way(t, EXITS[kind])
                    if kind is ast.Break:
                        self.way(Flow(flow.loop), "open")
                    continue
                todo += self.blocks(stmt, targets[0])
                if kind not in COMPOUND:
                    self.way(targets[0], "open")

    def way(self, flow: Flow, kind: str) -> None:
        if flow.after is not None:
            self.exits[flow.after][2].add("swallowed" if kind == "raise" and flow.shielded else kind)

    def blocks(self, stmt, flow: Flow) -> list:
        """Blocks of a statement with where each leads; notes the ways out that have no block."""
        kind, closed = type(stmt), Flow(None, False, flow.loop)
        if kind is ast.If:
            if not stmt.orelse:
                self.way(flow, "open")
            return [(stmt.body, flow), (stmt.orelse, flow)]
        if kind in (ast.With, ast.AsyncWith):
            return [(stmt.body, flow._replace(shielded=True))]
        if kind in (ast.For, ast.AsyncFor, ast.While):
            endless = kind is ast.While and constant(stmt.test) is True
            self.way(flow, "endless" if endless else "open")
            return [(stmt.body, Flow(None, False, flow.after)), (stmt.orelse, closed)]
        if kind in (ast.Try, ast.TryStar):
            final = any(type(s) in EXITS for s in stmt.finalbody)
            inside = closed if final else flow
            parts = [(stmt.body, closed if stmt.orelse else inside), (stmt.orelse, inside), *((h.body, inside) for h in stmt.handlers)]
            return [*parts, (stmt.finalbody, flow if final else closed)]
        if kind is ast.Match:
            self.way(flow, "open")
            return [(c.body, closed) for c in stmt.cases]
        if kind in (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef):
            return [(stmt.body, Flow())]
        return []

    # --- rows

    def snippet(self, line: int) -> str:
        shown = range(max(0, line - 3), min(len(self.lines), line + 2))
        return "\n".join(f"{i + 1:>4} | {self.lines[i][:500]}" for i in shown)

    def noqa(self, line: int) -> str | None:
        found = NOQA.search(self.lines[line - 1]) if line <= len(self.lines) else None
        return None if found is None else found["codes"] or ""

    def around(self, line: int) -> tuple[list[str], str | None]:
        """Names around the first node on a line, itself included, and its shape."""
        node, owners = self.first.get(line, (None, ()))
        own = [node.name] if type(node) in NAMED else []
        return [name for _, name in owners] + own, shape(node) if node is not None else None

    def read(self) -> dict:
        self.stack = []
        self.push(self.tree.body, self.scope(None, "module"))
        stack, first, handlers = self.stack, self.first, HANDLERS
        while stack:
            node, place = stack.pop()
            line = getattr(node, "lineno", None)
            if line is not None and line not in first:
                first[line] = (node, place.owners)
            handler = handlers.get(type(node))
            if handler is None:
                self.rest(node, place)
            else:
                handler(self, node, place)
        self.flows()
        return {
            "binds": [b for b in self.bound if b[1] in self.watched],
            "calls": self.call_rows(), "strings": self.string_rows(), "functions": self.function_rows(),
            "open_definitions": self.definition_rows(), "exits": self.exit_rows(),
            "tests": [(form, truth, [self.spot(n) for n in (line, other) if n]) for line, form, truth, other in self.tests],
            "uses": sorted(self.used),
        }

    def spot(self, line: int) -> tuple:
        return (line, self.noqa(line), *self.around(line), self.snippet(line))

    def call_rows(self) -> list:
        rows, outer = [], {}
        for node, place in self.called:
            at = (node.lineno, node.col_offset)
            top = outer.setdefault(at, node)  # of calls that begin at one place the outermost is met first
            func = dotted(node.func)
            if func is None or func.partition(".")[0] not in self.watched:
                continue
            given = [(None, i, ARGUMENTS.get(type(a), "other"), dotted(a), dotted(a.func) if type(a) is ast.Call else None) for i, a in enumerate(node.args[:2])]
            given += [(k.arg, None, ARGUMENTS.get(type(k.value), "other"), dotted(k.value), None) for k in node.keywords if k.arg]
            rows.append((*at, func, len(node.args), given, list(place.visible), [n for _, n in place.owners], shape(top), self.snippet(node.lineno)))
        return rows

    def string_rows(self) -> list:
        return [
            (node.lineno, node.col_offset, names, text, [n for _, n in place.owners], shape(node), self.snippet(node.lineno))
            for node, names, text, place in self.strings
        ]

    def function_rows(self) -> list:
        rows = []
        for node, place, own, direct in self.callables:
            kinds, names = [k for k, _ in place.owners], [n for _, n in place.owners]
            last_class = max((i for i, k in enumerate(kinds) if k == "c"), default=-1)
            class_name = names[-1] if kinds[-1:] == ["c"] else None
            static = any(type(d) is ast.Name and d.id == "staticmethod" for d in node.decorator_list)
            declared = len(node.args.posonlyargs) + len(node.args.args)
            local = any(a == "f" and b == "c" for a, b in zip(kinds, kinds[1:]))
            listed = ".".join([class_name, node.name] if class_name else [*names[last_class + 1 :], node.name])
            branches = sorted(own.branches.items())
            wanted = sum(own.branches.values()) + 1 >= self.watch.complexity or declared > self.watch.positional
            rows.append((node.lineno, node.col_offset, node.name, class_name, listed, declared, direct, static, local, branches, [*names, node.name], self.snippet(node.lineno) if wanted else None))
        return rows

    def definition_rows(self) -> list:
        """Declared names that the file itself never uses; one it uses cannot be unused in the snapshot."""
        rows = []
        for kind, name, line, statement, explicit in self.declared:
            if name not in self.used:
                scope, anchor = self.around(line)
                rows.append((line, kind, name, explicit, self.noqa(statement), scope, anchor if kind != "import" else "", self.snippet(line)))
        return rows

    def exit_rows(self) -> list:
        """Statements with the ways out of them; one that control may simply run through cannot hide what follows."""
        rows = []
        for line, kind, ways in self.exits:
            if ways and "open" not in ways:
                rows.append((kind, sorted(ways), [self.spot(line)]))
        return rows


NAMED = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
EXITS = {ast.Return: "return", ast.Raise: "raise", ast.Break: "break", ast.Continue: "continue"}
KINDS = {**EXITS, ast.If: "if", ast.With: "with", ast.AsyncWith: "with", ast.While: "while", ast.Try: "try", ast.TryStar: "try"}
COMPOUND = (ast.If, ast.With, ast.AsyncWith, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.TryStar, ast.Match)
LASTING = frozenset((*EXITS, *COMPOUND, *NAMED))
ARGUMENTS = {ast.Constant: "constant", ast.Call: "call"}
FIELDS = {
    cls: tuple(f for f in cls._fields if f not in PLAIN_FIELDS or (cls in (ast.Import, ast.ImportFrom) and f == "names"))
    for cls in vars(ast).values() if isinstance(cls, type) and issubclass(cls, ast.AST)
}
HANDLERS = {
    ast.Name: Reader.on_name, ast.Attribute: Reader.on_attribute, ast.Constant: Reader.nothing, ast.Global: Reader.nothing, ast.Nonlocal: Reader.nothing,
    ast.Import: Reader.on_import, ast.ImportFrom: Reader.on_import_from, ast.Call: Reader.on_call, ast.Assign: Reader.on_assign, ast.AnnAssign: Reader.on_annotated,
    ast.AugAssign: Reader.on_augmented, ast.FunctionDef: Reader.on_function, ast.AsyncFunctionDef: Reader.on_function, ast.Lambda: Reader.on_lambda,
    ast.arg: Reader.on_parameter, ast.ClassDef: Reader.on_class, ast.ListComp: Reader.on_comprehension, ast.SetComp: Reader.on_comprehension,
    ast.DictComp: Reader.on_comprehension, ast.GeneratorExp: Reader.on_comprehension, ast.MatchClass: Reader.on_match_class, ast.If: Reader.on_if,
    ast.IfExp: Reader.on_ternary, ast.While: Reader.on_while, ast.For: Reader.on_loop, ast.AsyncFor: Reader.on_loop, ast.Try: Reader.on_try, ast.TryStar: Reader.on_try,
    ast.BoolOp: Reader.on_logic, ast.Match: Reader.on_match, ast.Assert: Reader.on_assert,
}


def file_facts(source: str, watch: Watch) -> dict:
    """All facts of one file. Raises what ``ast.parse`` raises."""
    return Reader(source, watch).read()
