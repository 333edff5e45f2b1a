"""Word lists, annotation sets, limits and prefixes of the analysis."""

# --- fixed values -------------------------------------------------------------
BUILTIN_TYPES = (
    "String", "Object", "Integer", "Long", "Double", "Float", "Boolean", "Byte", "Short", "Character", "Void",
    "int", "long", "double", "float", "boolean", "byte", "short", "char", "void", "var",
)

API_ANNOTATIONS = (
    "RestController", "Controller", "RequestMapping", "GetMapping", "PostMapping", "PutMapping", "DeleteMapping",
    "PatchMapping", "Path", "GET", "POST", "PUT", "DELETE",
)
DOMAIN_ANNOTATIONS = ("Entity", "Table", "Document", "Embeddable", "MappedSuperclass")
DATA_ANNOTATIONS = ("Repository", "Dao")
SERVICE_ANNOTATIONS = ("Service",)
API_WORDS = ("controller", "endpoint", "resource", "router", "api", "rest", "web")
DATA_WORDS = ("repository", "repo", "dao", "persistence", "database", "mapper")

ROUTE_VERBS = {
    "GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "DeleteMapping": "DELETE", "PatchMapping": "PATCH",
    "GET": "GET", "POST": "POST", "PUT": "PUT", "DELETE": "DELETE", "PATCH": "PATCH",
}
ROUTE_ANNOTATIONS = (*ROUTE_VERBS, "RequestMapping")
TEST_ANNOTATIONS = ("Test", "ParameterizedTest", "RepeatedTest", "TestFactory")

LAYERS = ("api", "service", "domain", "data")
LAYER_LABELS = {"api": "API", "service": "Service", "domain": "Domain", "data": "Data"}
LAYER_RANKS = {"api": 0, "service": 1, "domain": 2, "data": 3}
UNRANKED_LAYER = 2
CLIENT, CLIENT_RANK, EXTERNAL_RANK = "Client", -1, 99

EXTERNAL_PREFIXES = {
    "Relational Database": (
        "java.sql", "javax.sql", "javax.persistence", "jakarta.persistence", "org.hibernate", "org.postgresql",
        "com.mysql", "com.microsoft.sqlserver", "oracle.jdbc", "com.zaxxer.hikari", "org.springframework.jdbc",
        "org.springframework.data.jpa", "org.flywaydb", "org.liquibase", "org.jooq", "org.apache.ibatis",
        "org.mybatis", "org.jdbi",
    ),
    "NoSQL / Cache": (
        "com.mongodb", "org.springframework.data.mongodb", "redis.clients", "org.springframework.data.redis",
        "io.lettuce", "com.datastax.oss", "com.couchbase",
    ),
    "Messaging / Streaming": (
        "org.apache.kafka", "org.springframework.kafka", "javax.jms", "jakarta.jms", "com.rabbitmq",
        "org.springframework.amqp",
    ),
    "HTTP / REST Client": (
        "okhttp3", "retrofit2", "org.apache.http", "org.apache.hc", "java.net.http", "feign",
        "org.springframework.web.client", "org.springframework.web.reactive.function.client",
    ),
    "Cloud Provider SDK": (
        "com.amazonaws", "software.amazon.awssdk", "com.google.cloud", "com.microsoft.azure", "com.azure",
    ),
    "Email / Notification": ("javax.mail", "jakarta.mail", "org.springframework.mail"),
}

MAX_FLOWS, MAX_STEPS, MAX_DEPTH = 8, 12, 4
MAX_CARDS, MAX_CARD_METHODS, MAX_CARD_FIELDS = 150, 40, 30
FAN_IN_WEIGHT, FAN_OUT_WEIGHT, ROUTE_BONUS = 3, 1, 15
DEFAULT_DETAIL_CHARS, MIN_CLASS_DETAIL_CHARS = 12_000, 1_500
MAX_DOMAIN_SHOWN, MAX_DOMAIN_FIELDS_SHOWN = 12, 6
MAX_NAMES_LISTED, MAX_EXTERNAL_ROOTS = 15, 15
MAX_README_TYPES, MAX_README_EXTERNALS = 25, 10
# ------------------------------------------------------------------------------
