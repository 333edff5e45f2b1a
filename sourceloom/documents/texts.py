"""Wording of the prompts."""

SYSTEM = (
    "You write technical documentation of Java code bases. What you get is a structural digest - types, "
    "signatures, dependencies - and never source text. Answer in plain, precise Markdown. State nothing "
    "about types, methods or behaviour the digest does not show, add no title for the document itself, and "
    "do not put the answer into a code fence."
)

NO_LAYERS = (
    "VERIFIED FACT: no annotation, name or class shape in this code base points to a layer. "
    "Claim no layered architecture unless the graph itself shows one."
)
LAYERS = "VERIFIED FACT: layers of the code base, from framework annotations first, then from names and class shape:"
LAYER_LINES = {
    "api": "- API layer (takes requests): ",
    "service": "- Service layer (business logic): ",
    "domain": "- Domain layer (business data): ",
    "data": "- Data layer (storage access): ",
}
LAYER_REST = "- Unclassified (nothing points to a layer; often utilities or configuration): %d types"

NO_SYSTEMS = (
    "VERIFIED FACT: the imports show no external system known to the analysis. "
    "Say that none was detected; do not guess whether there is one."
)
SYSTEMS = "VERIFIED FACT: external systems, as seen in imports:"

NO_DOMAIN = "No domain types were found: no class has a domain annotation, and none has the shape of plain data."
DOMAIN = "Domain types and their fields:"
DOMAIN_NOTE = (
    "(Fields and constants as declared. When and how they are set is not known here: "
    "describe no state changes unless a method shown elsewhere makes them.)"
)

NO_FLOWS = "(No call flow across classes could be resolved; calls on local variables cannot be followed.)"
NO_PRIMARY = "(No primary request flow could be resolved.)"
FLOW_NOTE = "(The diagram also has the way back to the client and any external system at the end; copy it unchanged.)"

README_TASK = """Write README.md with: an overview paragraph, worded as inferred from names; capabilities as a list, each
backed by a type above; the project structure by package; how to get started in general terms, without
build commands that nothing above proves; and the key components, the most central types first.
Keep it short."""

ARCHITECTURE_HEAD = """Facts marked VERIFIED FACT come from static analysis: repeat them as they are, without hedging. Anything
else you say is inference and must read like it."""

ARCHITECTURE_TASK = """Write ARCHITECTURE.md by responsibility and behaviour at run time, never by package. Sections, in order:
1. Overview - what the system does, from domain types, service methods and the primary flow.
2. Business Capabilities - what it can do for its users, not a list of classes.
3. Runtime Components - what each verified layer is responsible for here.
4. External Systems - the verified fact above.
5. Data Entry and Exit - where data comes in and where it goes, from the component graph.
6. Primary Request Flow - two to four sentences, then its diagram unchanged.
7. Component Dependency Graph - the graph unchanged, with its main directions explained.
8. Design Observations - coupling, cycles and patterns the graph or the classes show.
Do not speculate."""

SEQUENCE_HEAD = """Every flow below was traced through statically resolved calls and already has its diagram. Entry points are
public methods with a route annotation, or else those nothing calls and that call the most."""

SEQUENCE_TASK = """Write SEQUENCE.md with one section per flow, headed by its entry class and method: the diagram exactly as
given, then one to three sentences on what happens, from the names shown only. Without flows, say that
no call chain across classes was found."""

FOOTER = (
    "\n\n---\n*Written by sourceloom on {timestamp} from a static analysis. It knows the structure of the "
    "code, not its intent: read it before you rely on it.*\n"
)
