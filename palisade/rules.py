"""Rule tables.

Everything here is a FIXED VALUE: provider hosts, endpoint paths, method names,
patterns and thresholds that decide results and therefore must stay as they are.
Operators take these as defaults; callers may pass their own lists.
"""

# ---- Fixed values: provider hosts looked up by name (contains match, in order) ----
PROVIDER_HOSTS = [
    ("api.openai.com", "OpenAI"),
    ("api.anthropic.com", "Anthropic"),
    ("generativelanguage.googleapis.com", "Google"),
    ("aiplatform.googleapis.com", "Google"),
    ("openai.azure.com", "Azure"),
    ("cognitiveservices.azure.com", "Azure"),
    ("bedrock-runtime.us-east-1.amazonaws.com", "AWS Bedrock"),
    ("bedrock-runtime.us-west-2.amazonaws.com", "AWS Bedrock"),
    ("api.cohere.ai", "Cohere"),
    ("api-inference.huggingface.co", "HuggingFace"),
    ("api.mistral.ai", "Mistral"),
    ("api.groq.com", "Groq"),
    ("api.together.xyz", "Together"),
    ("api.deepseek.com", "DeepSeek"),
    ("api.perplexity.ai", "Perplexity"),
]

# ---- Fixed values: address prefixes. IPv4 = first two octets, IPv6 = first 32 bits in hex ----
PROVIDER_SUBNETS_V4 = [
    ("160.79", "Anthropic"),
    ("104.18", "OpenAI"),
    ("172.66", "OpenAI"),
    ("162.159", "OpenAI"),
]
PROVIDER_SUBNETS_V6 = [
    ("26076bc0", "Anthropic"),
    ("26001901", "Anthropic"),
]

# ---- Fixed values: server-name suffixes used when a payload has no request line ----
RESPONSE_SNI = [
    ("openai.com", "OpenAI"),
    ("anthropic.com", "Anthropic"),
    ("googleapis.com", "Google"),
    ("azure.com", "Azure"),
    ("amazonaws.com", "AWS Bedrock"),
    ("cohere.ai", "Cohere"),
    ("mistral.ai", "Mistral"),
    ("groq.com", "Groq"),
    ("together.xyz", "Together"),
    ("deepseek.com", "DeepSeek"),
    ("perplexity.ai", "Perplexity"),
]

# ---- Fixed values: endpoint rules (host part, path prefix, method or None, provider, endpoint) ----
# Rules with a host are tried first, in order; the ones without a host afterwards, in order.
ENDPOINT_RULES = [
    ("api.openai.com", "/v1/chat/completions", "POST", "OpenAI", "chat_completions"),
    ("api.openai.com", "/v1/completions", "POST", "OpenAI", "completions"),
    ("api.openai.com", "/v1/embeddings", "POST", "OpenAI", "embeddings"),
    ("api.openai.com", "/v1/images/generations", "POST", "OpenAI", "images"),
    ("api.openai.com", "/v1/audio", None, "OpenAI", "audio"),
    ("api.openai.com", "/v1/models", None, "OpenAI", "models"),
    ("api.anthropic.com", "/v1/messages", "POST", "Anthropic", "messages"),
    ("api.anthropic.com", "/v1/complete", "POST", "Anthropic", "complete"),
    ("generativelanguage.googleapis.com", "/v1beta/models", None, "Google", "gemini"),
    ("generativelanguage.googleapis.com", "/v1/models", None, "Google", "gemini"),
    ("aiplatform.googleapis.com", "/v1/projects", None, "Google", "vertex"),
    (None, "/openai/deployments/", None, "Azure", "openai"),
    ("bedrock-runtime", "/model/", "POST", "AWS Bedrock", "invoke"),
    (None, "/api/chat", "POST", "Ollama", "chat"),
    (None, "/api/generate", "POST", "Ollama", "generate"),
    (None, "/api/embeddings", "POST", "Ollama", "embeddings"),
    ("api.cohere.ai", "/v1/chat", "POST", "Cohere", "chat"),
    ("api.cohere.ai", "/v1/generate", "POST", "Cohere", "generate"),
    ("api.cohere.ai", "/v1/embed", "POST", "Cohere", "embed"),
    ("api.mistral.ai", "/v1/chat/completions", "POST", "Mistral", "chat_completions"),
    ("api.groq.com", "/openai/v1/chat/completions", "POST", "Groq", "chat_completions"),
    ("api.together.xyz", "/v1/chat/completions", "POST", "Together", "chat_completions"),
    ("api.deepseek.com", "/v1/chat/completions", "POST", "DeepSeek", "chat_completions"),
    ("api.perplexity.ai", "/chat/completions", "POST", "Perplexity", "chat_completions"),
    (None, "/v1/chat/completions", "POST", "OpenAI-compatible", "chat_completions"),
    (None, "/v1/completions", "POST", "OpenAI-compatible", "completions"),
    (None, "/v1/embeddings", "POST", "OpenAI-compatible", "embeddings"),
    (None, "/v1/messages", "POST", "Anthropic-compatible", "messages"),
    (None, "/chat/completions", "POST", "OpenAI-compatible", "chat_completions"),
]

# ---- Fixed values: user-agent substrings -> SDK name, in order ----
SDK_PATTERNS = [
    ("openai-python", "openai-python"),
    ("openai-node", "openai-node"),
    ("openai-java", "openai-java"),
    ("openai-go", "openai-go"),
    ("openai-dotnet", "openai-dotnet"),
    ("anthropic-python", "anthropic-python"),
    ("anthropic-typescript", "anthropic-typescript"),
    ("langchain", "langchain"),
    ("llama-index", "llama-index"),
    ("llamaindex", "llama-index"),
    ("crewai", "crewai"),
    ("autogen", "autogen"),
    ("semantic-kernel", "semantic-kernel"),
    ("curl", "curl"),
    ("python-requests", "python-requests"),
]

# ---- Fixed values: MCP method names -> category ----
MCP_METHODS = [
    ("tools/list", "Tools"),
    ("tools/call", "Tools"),
    ("tools/listChanged", "Tools"),
    ("resources/list", "Resources"),
    ("resources/read", "Resources"),
    ("resources/subscribe", "Resources"),
    ("resources/unsubscribe", "Resources"),
    ("resources/listChanged", "Resources"),
    ("resources/updated", "Resources"),
    ("prompts/list", "Prompts"),
    ("prompts/get", "Prompts"),
    ("prompts/listChanged", "Prompts"),
    ("initialize", "Lifecycle"),
    ("initialized", "Lifecycle"),
    ("ping", "Lifecycle"),
    ("cancelled", "Lifecycle"),
    ("shutdown", "Lifecycle"),
    ("completion/complete", "Completion"),
    ("logging/setLevel", "Logging"),
    ("logging/message", "Logging"),
    ("notifications/roots/listChanged", "Other"),
    ("sampling/createMessage", "Other"),
]
MCP_PREFIXES = ["tools/", "resources/", "prompts/", "logging/", "completion/", "notifications/", "sampling/"]

# ---- Fixed values: provider tags (lower-case spelling -> tag) ----
PROVIDER_TAGS = [
    ("openai", "OpenAI"),
    ("anthropic", "Anthropic"),
    ("google", "Google"),
    ("azure", "Azure"),
    ("aws bedrock", "AWS Bedrock"),
    ("aws", "AWS Bedrock"),
    ("bedrock", "AWS Bedrock"),
    ("cohere", "Cohere"),
    ("mistral", "Mistral"),
    ("groq", "Groq"),
    ("together", "Together"),
    ("deepseek", "DeepSeek"),
    ("perplexity", "Perplexity"),
    ("ollama", "Ollama"),
]
MCP_CATEGORY_TAGS = [
    ("tools", "Tools"),
    ("tool_use", "Tools"),
    ("resources", "Resources"),
    ("prompts", "Prompts"),
    ("lifecycle", "Lifecycle"),
    ("completion", "Completion"),
    ("logging", "Logging"),
]

# ---- Fixed values: process names and file-path patterns of AI tools, in order ----
AI_PROCESS_NAMES = ["claude", "cursor", "aider", "cody", "copilot", "continue", "windsurf", "tabby"]
AI_PATH_PATTERNS = [".claude", "CLAUDE.md", ".cursor", ".env", "skills/", ".anthropic"]

# ---- Fixed values: HTTP headers kept, methods recognised ----
KEPT_HEADERS = [
    "host",
    "content-type",
    "user-agent",
    "authorization",
    "x-api-key",
    "anthropic-version",
    "openai-organization",
    "accept",
]
HTTP_METHODS = ["GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS", "CONNECT"]
H2_PREFACE = "PRI * HTTP/2.0\r\n\r\nSM\r\n\r\n"

# ---- Fixed values: personal-data patterns (ASCII classes, explicit word edges) ----
PII_PATTERNS = [
    ("email", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"),
    ("phone", r"(?:\+?1[-. \t\r\n\f]?)?\(?[0-9]{3}\)?[-. \t\r\n\f]?[0-9]{3}[-. \t\r\n\f]?[0-9]{4}"),
    (
        "credit_card",
        r"(?:^|[^A-Za-z0-9_])(?:4[0-9]{3}|5[1-5][0-9]{2}|3[47][0-9]{2}|6(?:011|5[0-9]{2}))"
        r"[- ]?[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}(?:$|[^A-Za-z0-9_])",
    ),
    ("ssn", r"(?:^|[^A-Za-z0-9_])[0-9]{3}-[0-9]{2}-[0-9]{4}(?:$|[^A-Za-z0-9_])"),
    ("api_key", r"(?:sk-|api[_-]key[=:][ \t\r\n\f]*)[a-zA-Z0-9_-]{20,}"),
]
PII_LIST_ORDER = ["email", "credit_card", "ssn", "phone", "api_key"]

# ---- Fixed values: confidences of the payload classes ----
CONFIDENCE = {
    "request_mcp": 0.95,
    "request_endpoint": 0.9,
    "jsonrpc": 0.6,
    "generic": 0.3,
    "response_mcp": 0.9,
    "response_body": 0.85,
    "sse": 0.85,
    "raw_mcp": 0.8,
    "raw_body": 0.7,
    "raw_sse": 0.7,
}

# ---- Fixed values: windows, sessions, identities ----
SNI_TTL_NS = 300 * 1_000_000_000
CONNECTION_TTL_NS = 300 * 1_000_000_000
UNDECIDED_CHUNKS = 10
FLOW_CAP = 128 * 1024
WINDOW_SIZE, WINDOW_MIN, WINDOW_STRIDE = 50, 20, 10
SYMBOLS, BIGRAM_BINS, TRIGRAM_BINS = 180, 100, 50
BURST_GAP_NS = 500 * 1_000_000
TIMELINE_CAP = 256
RELAY_WINDOW_MS = 5000
RECENT_EVENTS = 5000

# ---- Fixed values: identity matching ----
MATCH_CONFIDENCE = {"ExactInstance": 1.0, "StrongType": 0.95, "MediumType": 0.75, "Weak": 0.45, "New": 0.3}
SCORE_WEIGHTS = {
    "fallback": {"prompt": 0.15, "type": 0.40, "behavior": 0.25, "network": 0.20},
    "semantic": {"prompt": 0.40, "type": 0.25, "behavior": 0.20, "network": 0.15},
}
TYPE_WEIGHTS = {"sig": 0.4, "sdk": 0.3, "model": 0.3}
COMPOSITE_THRESHOLD, SEMANTIC_THRESHOLD = 0.60, 0.85
SIMHASH_PLANES, SIMHASH_SEED = 64, 0xBEEFCAFEDEADF00D
