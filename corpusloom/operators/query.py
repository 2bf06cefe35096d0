"""Query understanding: rewrites, classes, follow-ups and templates, as expressions over a table of queries."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Lists and patterns that decide results, in the order in which they apply.
ABBREVIATIONS = (
    ("k8s", "kubernetes"), ("k3s", "k3s kubernetes"), ("ns", "namespace"), ("hpa", "horizontal pod autoscaler"),
    ("pvc", "persistent volume claim"), ("pv", "persistent volume"), ("cm", "configmap"), ("sa", "service account"),
    ("ing", "ingress"), ("svc", "service"), ("deploy", "deployment"), ("tf", "terraform"), ("iac", "infrastructure as code"),
    ("aws", "amazon web services AWS"), ("gcp", "google cloud platform GCP"), ("az", "azure"), ("gh", "github"),
    ("ci/cd", "continuous integration continuous delivery"), ("cicd", "continuous integration continuous delivery"),
)
CODE_QUERY = (
    r"(?i)(code|function|class|method|implement|syntax|example|snippet|how to|how do i|write|create|def |class |async |await |import |from |return |"
    r"print\(|console\.|kubectl|docker|terraform|ansible|helm|yaml|json|error|exception|traceback|debug|fix)"
)
GENERAL_PREFIX = "Represent this sentence for searching relevant passages: "
CODE_PREFIX = "Represent this code or programming query for searching relevant code examples and documentation: "
COMPLEXITY = (
    ("multi_step", r"(?i)\b(step|steps|process|workflow|pipeline|then|after|before)\b"),
    ("conditional", r"(?i)\b(if|when|unless|depending|based on)\b"),
    ("comparison", r"(?i)\b(compare|vs|versus|difference|better|which)\b"),
)
TASKS = (
    ("generate", (r"(?i)\b(create|write|generate|build|make|implement|setup|configure|add)\b.*\?*$", r"(?i)\b(example|template|sample)\s+(of|for)\b")),
    ("explain", (r"(?i)\b(explain|what is|what are|how does|describe|define|understand)\b", r"(?i)\b(difference|differences?)\s+between\b", r"(?i)\bwhy\s+(should|would|do|does|is|are)\b")),
    ("debug", (r"(?i)\b(error|bug|fix|debug|troubleshoot|not working|failing|issue|problem)\b", r"(?i)\b(crash|exception|traceback|failed)\b")),
    ("compare", (r"(?i)\b(compare|vs|versus|or)\b.*\b(which|better|difference)\b", r"(?i)\b(pros|cons|advantages|disadvantages)\b")),
)
DOMAINS = (
    ("kubernetes", ("kubernetes", "k8s", "kubectl", "pod", "deployment", "service", "ingress", "namespace", "configmap", "secret", "pvc", "pv", "statefulset", "daemonset", "replicaset")),
    ("docker", ("docker", "dockerfile", "container", "image", "docker-compose", "docker compose")),
    ("terraform", ("terraform", "tf", "hcl", "tfstate", "tfvars", "provider", "resource", "module")),
    ("ansible", ("ansible", "playbook", "ansible-playbook", "inventory", "role", "task", "handler", "ansible-vault")),
    ("helm", ("helm", "chart", "values.yaml", "helmfile", "helm install", "helm upgrade")),
    ("cicd", ("github actions", "gitlab ci", "jenkins", "pipeline", "workflow", "ci/cd", "cicd", "build pipeline", "deploy pipeline")),
)
SKIPS = (
    ("error_message", r"(?i)(error|exception|traceback|failed|cannot|unable|denied|refused|timeout|connection refused|permission denied|not found|no such|invalid|ENOENT|EACCES|ETIMEDOUT|OOMKilled|CrashLoopBackOff)"),
    ("cli_command", r"(?i)^(kubectl|docker|terraform|ansible|helm|git|aws|gcloud|az|systemctl|journalctl|curl|wget|ssh|scp|rsync|make|npm|pip|podman|crictl|istioctl|argocd|flux)\s+"),
    ("file_path", r"(?i)(/[a-zA-Z0-9_.-]+){2,}|[a-zA-Z]:\\\\|\.(yaml|yml|json|tf|md|py|sh|conf|config)$"),
    ("config_snippet", r'(?im)(apiVersion:|kind:|metadata:|spec:|name:|image:|ports:|"[^"]+"\s*:\s*["\[{]|^\s*-\s+\w+:)'),
    ("log_entry", r"(?i)\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}|\[(INFO|WARN|ERROR|DEBUG|FATAL)\]|level=(info|warn|error|debug)"),
    ("network_specific", r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(:\d+)?|https?://[^\s]+|:[0-9]{2,5}\b"),
    ("resource_identifier", r"[a-z0-9]+-[a-z0-9]+-[a-z0-9]+|sha256:[a-f0-9]{64}|[a-f0-9]{40}"),
)
CONTEXT_LIMITS = (
    ("llama3.1", 96000), ("llama3.2", 96000), ("llama3", 6144), ("mistral", 24576), ("mixtral", 24576), ("qwen2.5", 24576),
    ("qwen2.5-coder", 24576), ("codellama", 12288), ("deepseek", 24576), ("phi", 3072),
)
DEFAULT_CONTEXT = 4096
REFERENCES = (
    ("it", r"(?i)\b(it|its)\b"), ("that", r"(?i)\b(that|those)\b"), ("this", r"(?i)\b(this|these)\b"), ("they", r"(?i)\b(they|them|their)\b"),
    ("the_same", r"(?i)\b(the same|same thing|same one|the above)\b"), ("mentioned", r"(?i)\b(mentioned|described|discussed|explained)\b"),
    ("previous", r"(?i)\b(previous|earlier|before|last|prior)\b"),
)
TERM_FAMILIES = (
    r"(?i)\b(pod|pods|deployment|deployments|service|services|configmap|configmaps|secret|secrets|namespace|namespaces|ingress|ingresses|statefulset|statefulsets|daemonset|daemonsets|replicaset|replicasets|cronjob|cronjobs|job|jobs|persistentvolume|persistentvolumeclaim|pv|pvc|node|nodes|cluster|clusters|container|containers|serviceaccount|networkpolicy|resourcequota|limitrange|horizontalpodautoscaler|hpa|verticalpodautoscaler|vpa)\b",
    r"(?i)\b(docker|dockerfile|container|image|registry|podman|containerd|cri-o|buildah|kaniko|layer|volume|mount|compose|swarm)\b",
    r"(?i)\b(terraform|ansible|helm|kustomize|chart|playbook|role|task|module|provider|state|plan|apply|destroy|workspace|variable|output|resource|data|locals)\b",
    r"(?i)\b(aws|amazon|ec2|s3|rds|lambda|iam|vpc|eks|ecs|fargate|cloudformation|gcp|google cloud|gke|compute engine|cloud run|azure|aks|arm|blob|digitalocean|linode|vultr)\b",
    r"(?i)\b(jenkins|gitlab|github actions|circleci|travis|argocd|flux|spinnaker|tekton|pipeline|workflow|stage|step|job|build|deploy|release|rollout|rollback)\b",
    r"(?i)\b(prometheus|grafana|datadog|newrelic|elasticsearch|kibana|logstash|elk|jaeger|zipkin|opentelemetry|metric|metrics|log|logs|trace|traces|alert|alerting|dashboard|slo|sli|sla)\b",
    r"(?i)\b(loadbalancer|load balancer|nginx|haproxy|envoy|istio|linkerd|service mesh|dns|ssl|tls|certificate|cert|firewall|security group|network policy|port|endpoint|url|domain)\b",
    r"(?i)\b(scale|scaling|autoscale|autoscaling|restart|crash|crashloop|oom|memory|cpu|permission|access|authentication|authorization|backup|restore|migrate|migration|debug|troubleshoot|error|issue|problem)\b",
)
#: Of the terms too common to help, those that a family can match.
STOP_TERMS = ("step",)
TOPIC_FIRST = ("pod", "pods", "deployment", "deployments", "service", "kubernetes", "k8s", "container", "containers")
_VERB = r"(?!\s+(?:is|was|are|were|has|have|can|could|will|would|should|must|may|might))"
RESOLUTIONS = (r"\b(it|its)\b", r"\b(that)\b" + _VERB, r"\bthe same thing\b", r"\bthe same\b", r"\bthis\b" + _VERB)


def _first(pairs: list[tuple[Column, object]], otherwise: Column) -> Column:
    return F.coalesce(*[F.when(test, F.lit(value)) for test, value in pairs], otherwise)


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def expand_abbreviations(text: Column) -> Column:
    """Whole-word rewrites in order, each seeing what those before it made."""
    return collapse(reduce(lambda t, r: F.regexp_replace(t, rf"(?i)\b\Q{r[0]}\E\b", r[1]), ABBREVIATIONS, collapse(text)))


def is_code_query(text: Column) -> Column:
    return text.rlike(CODE_QUERY)


def embed_prefix(text: Column) -> Column:
    return F.concat(F.when(is_code_query(text), CODE_PREFIX).otherwise(GENERAL_PREFIX), text)


def _occurrences(text: Column, part: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)


def complexity(text: Column) -> Column:
    """struct(score 0 to 5, is_complex, scaffold: none, short or full)."""
    tests = [F.size(words(text)) > 20, (_occurrences(text, " and ") >= 2) | (_occurrences(text, ",") >= 3), *[text.rlike(p) for _, p in COMPLEXITY]]
    score = reduce(lambda a, b: a + b, [t.cast("int") for t in tests])
    scaffold = F.when(score >= 3, "full").when(score == 2, "short").otherwise("none")
    return F.struct(score.alias("score"), (score >= 2).alias("is_complex"), scaffold.alias("scaffold"))


def task_type(text: Column) -> Column:
    return _first([(text.rlike(p), name) for name, patterns in TASKS for p in patterns], F.lit("general"))


def few_shot_domain(text: Column) -> Column:
    low = F.lower(text)
    return _first([(low.contains(k), name) for name, keys in DOMAINS for k in keys], F.lit(None).cast("string"))


def hyde_gate(text: Column, least: int = 10, most: int = 500) -> Column:
    """Why a query is not expanded, or null."""
    t = F.trim(text)
    tests = [(F.length(t) < least, "query_too_short"), (F.length(t) > most, "query_too_long"), *[(t.rlike(p), name) for name, p in SKIPS], (F.size(words(t)) > 30, "too_many_words")]
    return _first(tests, F.lit(None).cast("string"))


def context_limit(model: Column) -> Column:
    low = F.lower(F.coalesce(model, F.lit("")))
    return _first([(low.contains(name), limit) for name, limit in CONTEXT_LIMITS], F.lit(DEFAULT_CONTEXT))


def query_hashes(text: Column) -> Column:
    raw = text.cast("binary")
    return F.struct(*[F.substring(F.sha2(raw, 256), 1, n).alias(f"sha{n}") for n in (12, 16)], *[F.substring(F.md5(raw), 1, n).alias(f"md5_{n}") for n in (12, 16)])


def history(messages: DataFrame, limit: int = 10) -> DataFrame:
    """Per session the last `limit` messages, in order, and how many there are. Message rows are ranked before they are
    gathered, so a session never holds more than the limit."""
    newest = Window.partitionBy("session_id").orderBy(F.col("turn").desc())
    last = messages.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= limit)
    counts = messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("messages"))
    return (
        last.groupBy("session_id")
        .agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("history"))
        .join(counts, "session_id")
        .withColumn("is_cut", F.col("messages") > limit)
    )


def references(text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(text.rlike(p), name) for name, p in REFERENCES]))


def domain_terms(text: Column) -> Column:
    """Distinct lower-case terms of the families, longer than two characters, in order of their families and places."""
    found = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in TERM_FAMILIES]))
    low = F.array_distinct(F.transform(found, lambda t: F.lower(t)))
    return F.filter(low, lambda t: (F.length(t) > 2) & ~t.isin(*STOP_TERMS))


def conversation_context(messages: DataFrame, pairs: int = 3, most: int = 10) -> DataFrame:
    """Each message of a session with terms (of the messages before it, the first ten in alphabetic order) and topic (of
    the latest user message among these: its first two terms, container terms preferred)."""
    before = Window.partitionBy("session_id").orderBy("turn").rowsBetween(-2 * pairs, -1)
    rows = messages.withColumn("_own", domain_terms(F.coalesce("text", F.lit(""))))
    user = F.when((F.col("role") == "user") & (F.length("text") > 0), F.struct("turn", "_own"))
    rows = rows.withColumn("_all", F.flatten(F.collect_list("_own").over(before))).withColumn("_last", F.max(user).over(before)["_own"])
    sorted_ = F.array_sort(F.coalesce("_last", F.array().cast("array<string>")))
    first = F.filter(sorted_, lambda t: t.isin(*TOPIC_FIRST))
    topic = F.array_join(F.slice(F.when(F.size(first) > 0, first).otherwise(sorted_), 1, 2), " ")
    has_user = F.count(F.when(F.col("role") == "user", 1)).over(before) > 0
    return rows.withColumn("terms", F.slice(F.array_sort(F.array_distinct("_all")), 1, most)).withColumn("topic", topic).withColumn(
        "history_size", F.count(F.lit(1)).over(before)
    ).withColumn("has_user", has_user).drop("_own", "_all", "_last")


def should_expand(text: Column, history_size: Column, has_user: Column, least: int = 10) -> Column:
    """Why a follow-up is not expanded, or null."""
    t = F.trim(text)
    reason = (
        F.when(F.coalesce(history_size, F.lit(0)) == 0, "no_conversation_history")
        .when(~has_user, "no_prior_user_messages")
        .when((F.size(references(t)) > 0) & (F.length(t) < 50), None)
        .when(F.size(words(t)) <= 5, None)
        .when(F.size(domain_terms(t)) >= 3, "query_already_specific")
        .when(F.length(t) <= least * 20, None)
        .otherwise("query_too_long")
    )
    return reason


def expand_followup(text: Column, terms: Column, topic: Column) -> Column:
    """The query with its first resolvable reference replaced once by the topic, or up to three unseen terms appended.

    The lists of a set's terms are sorted; only the first pattern that occurs is replaced."""
    resolved = text
    for pattern in reversed(RESOLUTIONS):
        once = F.regexp_replace(text, F.lit(rf"(?is)^(.*?)(?:{pattern.replace('(it|its)', '(?:it|its)').replace('(that)', 'that')})"), F.concat(F.lit("$1"), F.replace(topic, F.lit("$"), F.lit(r"\$"))))
        resolved = F.when(text.rlike("(?i)" + pattern), once).otherwise(resolved)
    new = F.slice(F.filter(terms, lambda t: ~F.contains(F.lower(text), t)), 1, 3)
    added = F.when(F.size(new) > 0, F.concat_ws(" ", text, F.array_join(new, " "))).otherwise(text)
    return F.when((F.size(references(text)) > 0) & (topic != ""), resolved).otherwise(added)


def compaction_plan(messages: DataFrame, threshold: int = 10, keep: int = 5) -> DataFrame:
    """Messages of sessions of at least `threshold` with action `summarise` or `keep`; the newest `keep` stay, and a
    session is left alone unless it has as many older ones."""
    newest = Window.partitionBy("session_id").orderBy(F.col("turn").desc())
    counts = messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("messages"))
    big = counts.filter((F.col("messages") >= threshold) & (F.col("messages") - keep >= keep))
    ranked = messages.join(big, "session_id").withColumn("_n", F.row_number().over(newest))
    return ranked.withColumn("action", F.when(F.col("_n") > keep, "summarise").otherwise("keep")).drop("_n")


def session_stats(messages: DataFrame) -> DataFrame:
    return messages.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("messages"), F.count_if(F.col("role") == "user").alias("user_messages"), F.max("turn").alias("last_turn")
    )


VARIABLE = r"(?<!\{)\{([a-zA-Z_][a-zA-Z0-9_]*)\}(?!\})"


def template_variables(prompt: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(prompt, F.lit(VARIABLE), F.lit(1)))


def validate_template(variables: Column, values: Column) -> Column:
    """struct(is_valid, missing, unknown) for variables (array of struct with name and required) and a map of values."""
    names = F.transform(variables, lambda v: v["name"])
    required = F.transform(F.filter(variables, lambda v: F.coalesce(v["required"], F.lit(False))), lambda v: v["name"])
    missing = F.array_except(required, F.map_keys(values))
    return F.struct((F.size(missing) == 0).alias("is_valid"), F.array_sort(missing).alias("missing"), F.array_sort(F.array_except(F.map_keys(values), names)).alias("unknown"))


def render_template(prompt: Column, variables: Column, values: Column) -> Column:
    """The prompt with each variable's value, else its default, else <name>; numbers and booleans are written as such."""
    defined = F.transform(variables, lambda v: v["name"])
    others = F.transform(
        F.array_except(template_variables(prompt), defined),
        lambda n: F.struct(n.alias("name"), F.lit("string").alias("type"), F.lit(None).cast("string").alias("default")),
    )
    known = F.transform(variables, lambda v: F.struct(v["name"].alias("name"), v["type"].alias("type"), v["default"].alias("default")))

    def text_of(v: Column) -> Column:
        given = F.try_element_at(values, v["name"])
        number = F.coalesce(F.when(~F.contains(given, F.lit(".")), F.expr("null").cast("string")), given)
        as_int = F.when(~given.contains("."), given.try_cast("long").cast("string"))
        typed = (
            F.when(v["type"] == "number", F.coalesce(as_int, given.try_cast("double").cast("string"), number))
            .when(v["type"] == "boolean", F.initcap(F.lower(given).isin("true", "1", "yes").cast("string")))
            .otherwise(given)
        )
        return F.coalesce(typed, v["default"], F.concat(F.lit("<"), v["name"], F.lit(">")))

    def put(acc: Column, v: Column) -> Column:
        return F.replace(acc, F.concat(F.lit("{"), v["name"], F.lit("}")), text_of(v))

    return F.aggregate(F.concat(known, others), prompt, put)


def templates_by_category(templates: DataFrame) -> DataFrame:
    return templates.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("name")).alias("names"))


def chain_expanders(queries: DataFrame, steps: list[tuple[str, Callable[[Column], Column]]], text: str = "text") -> DataFrame:
    """Applies expanders in order; adds expanded and applied, the names of those that changed the query."""
    out = queries.withColumn("expanded", F.col(text)).withColumn("applied", F.array().cast("array<string>"))
    for name, step in steps:
        out = out.withColumn("_next", step(F.col("expanded")))
        changed = ~F.col("_next").eqNullSafe(F.col("expanded"))
        out = out.withColumn("applied", F.when(changed, F.array_append("applied", F.lit(name))).otherwise(F.col("applied")))
        out = out.withColumn("expanded", F.col("_next")).drop("_next")
    return out


def validate_queries(queries: DataFrame, most: int = 10_000, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(queries with the text trimmed, rejected queries with a reason)."""
    t = F.trim(F.coalesce(F.col(text), F.lit("")))
    marked = queries.withColumn(text, t).withColumn("reason", F.when(F.length(text) == 0, "empty").when(F.length(text) > most, "too_long"))
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")
