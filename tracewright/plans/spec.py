"""Declaring workflows: components, thread graphs, functions, and link rules. Plain objects, compiled once on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field


class SpecError(ValueError):
    """A declaration that contradicts itself."""


@dataclass
class Registry:
    """Services and their components, by name; registration order is kept."""

    services: dict[str, list[str]] = field(default_factory=dict)

    def register(self, service: str, *components: str) -> Registry:
        own = self.services.setdefault(service, [])
        for c in components:
            if any(c in x for x in self.services.values()):
                raise SpecError(f"component {c} is registered already")
            own.append(c)
        return self

    @property
    def components(self) -> list[str]:
        return [c for x in self.services.values() for c in x]

    def resolve(self, name: str) -> str:
        if name not in self.components:
            raise SpecError(f"unknown component {name}")
        return name


class Edge:
    """From a node to a node, by a keyword or by calling a function."""

    def __init__(self, name: str, source: Node, target: Node, keyword: str | None, call: Function | None):
        self.name, self.source, self.target, self.keyword, self.call = name, source, target, keyword, call
        self.refresh: list[str] = []
        self.links: list[Link] = []

    def refresh_var(self, var: str) -> Edge:
        """The edge gives a recycled id a new version."""
        self.refresh.append(var)
        return self

    def first_keyword(self) -> str:
        return self.keyword if self.call is None else self.call.first.first_keyword()

    def _link(self, strategy: str, to: Edge, remote: bool, schema, request: str | None) -> Link:
        if self.links and self.links[0].strategy != strategy:
            raise SpecError("an edge has one strategy")
        pairs = [(s, s) if isinstance(s, str) else tuple(s) for s in schema]
        pairs = _keyed(pairs, remote)
        master = self.source.graph.master
        master.ranks += 1
        link = Link(f"{self.name}>{to.name}", strategy, self, to, remote, pairs, request, rank=master.ranks)
        self.links.append(link)
        return link

    def join_one(self, to: Edge, remote: bool, schema, request: str | None = None) -> Link:
        return self._link("ONE", to, remote, schema, request)

    def join_all(self, to: Edge, remote: bool, schema, request: str | None = None) -> Link:
        return self._link("ALL", to, remote, schema, request)

    def join_any(self, to: Edge, remote: bool, schema, request: str | None = None) -> Link:
        return self._link("ANY", to, remote, schema, request)


def _keyed(pairs: list[tuple[str, str]], remote: bool) -> list[tuple[str, str]]:
    """The schema of a link; a local one is keyed by target and host as well."""
    if "thread" in {x for p in pairs for x in p} or remote and any(a == b and a in ("target", "host") for a, b in pairs):
        raise SpecError("a link may not be keyed by thread, nor a remote one by its own target or host")
    return pairs if remote else [("target", "target"), ("host", "host"), *pairs]


@dataclass
class Link:
    """A first-in-first-out link rule between two edges; `call` nests another request's path inside."""

    name: str
    strategy: str
    source: Edge
    target: Edge
    remote: bool
    schema: list[tuple[str, str]]
    request: str | None = None
    call: tuple[Call, Call] | None = None
    rank: int = 0

    def call_req(self, enter: Edge, enter_remote: bool, enter_schema, leave: Edge, leave_remote: bool, leave_schema) -> Link:
        """The request is served by another one, which is entered at one edge and left at another."""
        if self.request is None or self.call is not None:
            raise SpecError("only a request link calls a request, and only one")
        both = [[(s, s) if isinstance(s, str) else tuple(s) for s in x] for x in (enter_schema, leave_schema)]
        self.call = (Call(enter, enter_remote, _keyed(both[0], enter_remote)), Call(leave, leave_remote, _keyed(both[1], leave_remote)))
        return self


@dataclass
class Call:
    """One side of a nested call: the callee's edge, and the schema from caller to callee (entering) or back (leaving)."""

    edge: Edge
    remote: bool
    schema: list[tuple[str, str]]


class Node:
    def __init__(self, graph, name: str):
        self.graph, self.name = graph, name
        self.edges: list[Edge] = []
        self.end = self.request_type = self.state = self.mark = None

    def build(self, to: Node | int, payload: str | Function | Edge) -> tuple[Edge, Node]:
        """An edge to a new node (an int id), or to a node that is there (a loop or a merge); an edge may be shared.

        A shared edge stays one edge, with its refreshes and links, and leads to its own node, given or named. An edge
        into another thread graph of the same component makes one graph of the two.
        """
        if isinstance(payload, Edge):
            edge, node = payload, payload.target
            if to is not node and not (isinstance(to, int) and node.name == f"{node.graph.prefix}{to}"):
                raise SpecError(f"edge {edge.name} leads to {node.name}, not to {to if isinstance(to, int) else to.name}")
        else:
            node = to if isinstance(to, Node) else self.graph.node(to)
            keyword, call = (None, payload) if isinstance(payload, Function) else (payload, None)
            edge = Edge(self.graph.master.edge_name(), self, node, keyword, call)
        new = edge.first_keyword()
        for e in self.edges:  # an earlier keyword inside the new one would always win; the other way round is legal
            if e.first_keyword() in new:
                raise SpecError(f"{e.first_keyword()!r} hides {new!r} at {self.name}")
        if node.graph is not self.graph:
            if not isinstance(self.graph, ThreadGraph) or not isinstance(node.graph, ThreadGraph):
                raise SpecError(f"{self.name} and {node.name} stand in graphs that do not merge")
            self.graph.merge(node.graph)
        self.edges.append(edge)
        return edge, node

    def build_endf(self, payload: str | Function | Edge) -> Edge:
        return self.build(self.graph.end_node, payload)[0]

    def set_end(self) -> Node:
        self.end = True
        return self

    def set_state(self, state: str, is_mark: bool = False) -> Node:
        if self is self.graph.start or self in getattr(self.graph, "starts", ()):
            raise SpecError("a start node has no state")
        if is_mark:
            self.mark = state
        else:
            self.state = state
        return self


class _Graph:
    start: Node

    def __init__(self, master: Master, prefix: str):
        self.master, self.prefix = master, prefix
        self.nodes: dict[str, Node] = {}

    def node(self, ident: int | str) -> Node:
        name = f"{self.prefix}{ident}"
        if name in self.nodes:
            raise SpecError(f"node {name} is there already")
        self.nodes[name] = Node(self, name)
        return self.nodes[name]


class Function(_Graph):
    """A sub-automaton with a start and an end node of its own; a call consumes lines from its first keyword on."""

    def __init__(self, master: Master, name: str):
        super().__init__(master, f"n_{name}")
        self.name = name
        self.start, self.end_node = Node(self, f"{name}_s"), Node(self, f"{name}_e")

    @property
    def first(self) -> Edge:
        return self.start.edges[0]


class ThreadGraph(_Graph):
    def __init__(self, master: Master, component: str, start_name: str):
        super().__init__(master, "n")
        self.component = component
        self.start = Node(self, start_name)
        self.starts = [self.start]

    def merge(self, other: ThreadGraph) -> ThreadGraph:
        """One graph of two of the same component; their starts are tried in order."""
        if other.component != self.component:
            raise SpecError("graphs of two components do not merge")
        for n in [*other.nodes.values(), *other.starts]:
            n.graph = self
        self.nodes |= other.nodes
        self.starts += other.starts
        self.master.graphs.remove(other)
        return self


class Master:
    """All graphs of a workflow, and the names of their parts."""

    def __init__(self, name: str, registry: Registry):
        self.name, self.registry = name, registry
        self.graphs: list[ThreadGraph] = []
        self.functions: dict[str, Function] = {}
        self._edges = self.ranks = 0

    def edge_name(self) -> str:
        self._edges += 1
        return f"e{self._edges}"

    def build_thread(self, component: str, to: int, payload, request_type: str | None = None) -> tuple[Edge, Node]:
        self.registry.resolve(component)
        if request_type and request_type in self.request_types:
            raise SpecError(f"request type {request_type} is there already")
        graph = ThreadGraph(self, component, f"nq_{request_type}" if request_type else f"ns{len(self.graphs) + 1}")
        taken = {n for g in self.graphs for n in g.nodes}
        if f"n{to}" in taken:
            raise SpecError(f"node n{to} is there already")
        graph.start.request_type = request_type
        self.graphs.append(graph)
        return graph.start.build(to, payload)

    def build_func(self, to: int, payload, name: str) -> tuple[Edge, Node, Function]:
        if name in self.functions:
            raise SpecError(f"function {name} is there already")
        f = self.functions[name] = Function(self, name)
        edge, node = f.start.build(to, payload)
        return edge, node, f

    # -- introspection -------------------------------------------------------------------------------------------
    @property
    def request_types(self) -> list[str]:
        return [s.request_type for g in self.graphs for s in g.starts if s.request_type]

    @property
    def request_states(self) -> list[str]:
        return [n.state for n in self.iter_nodes() if n.state]

    def iter_nodes(self):
        for g in self.graphs:
            yield from g.starts
            yield from g.nodes.values()
        for f in self.functions.values():
            yield f.start
            yield from f.nodes.values()
            yield f.end_node

    def iter_edges(self):
        """Every edge once, shared ones too."""
        seen = set()
        for n in self.iter_nodes():
            for e in n.edges:
                if e.name not in seen:
                    seen.add(e.name)
                    yield e

    def links(self) -> list[Link]:
        """All link rules in the order of their declaration."""
        return sorted((link for e in self.iter_edges() for link in e.links), key=lambda link: link.rank)

    def refreshes(self) -> dict[str, list[str]]:
        """Edge name to the variables that it gives a new version."""
        return {e.name: e.refresh for e in self.iter_edges() if e.refresh}

    # -- compilation ---------------------------------------------------------------------------------------------
    def compile(self) -> Automaton:
        return Automaton(self)


class Automaton:
    """The workflow as tables of plain values: small, picklable, and stepped with a memory of what was seen."""

    def __init__(self, master: Master):
        nodes = list(master.iter_nodes())
        index = {id(n): i for i, n in enumerate(nodes)}
        first = {f.name: (index[id(f.start)]) for f in master.functions.values()}
        function_ends = {index[id(f.end_node)] for f in master.functions.values()}
        self.names = [n.name for n in nodes]
        self.edges = [[(e.name, e.first_keyword(), index[id(e.target)], None if e.call is None else first[e.call.name]) for e in n.edges] for n in nodes]
        self.function_end = function_ends
        thread_nodes = {id(n) for g in master.graphs for n in g.nodes.values()}
        self.end = {i for i, n in enumerate(nodes) if n.end or id(n) in thread_nodes and not n.edges}
        self.state = {i: n.state for i, n in enumerate(nodes) if n.state}
        self.mark = {i: n.mark for i, n in enumerate(nodes) if n.mark}
        self.starts: dict[str, list[tuple[int, str, str | None]]] = {}
        for g in master.graphs:
            for s in g.starts:
                self.starts.setdefault(g.component, []).append((index[id(s)], s.name, s.request_type))
        self._memory: dict = {}

    def step(self, node: int, stack: tuple, keyword: str):
        """(edge, node, stack) after a line, or None. The first edge in order whose keyword is inside the line's is taken."""
        key = (node, stack, keyword)
        if key in self._memory:
            return self._memory[key]
        out = None
        for name, wanted, target, call in self.edges[node]:
            if wanted in keyword:
                while call is not None:  # a call goes down to the function's first keyword, which this line matches
                    stack = (*stack, target)
                    name, _, target, call = self.edges[call][0]
                while target in self.function_end and stack:
                    target, stack = stack[-1], stack[:-1]
                out = (name, target, stack)
                break
        self._memory[key] = out
        return out

    def start(self, component: str, keyword: str):
        """(start node, start name, request type, edge, node, stack) of the first graph of the component that takes the line."""
        for node, name, kind in self.starts.get(component, ()):
            if (got := self.step(node, (), keyword)) is not None:
                return (node, name, kind, *got)
        return None

    def complete(self, node: int, stack: tuple) -> bool:
        return not stack and node in self.end
