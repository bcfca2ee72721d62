"""Fixed values of the deployment model.

Everything in this module is data, not logic: address plans, ports, rule and
service templates, configuration defaults, the state keys and the teardown
steps. The operators turn these tables into Spark expressions or small
broadcast-free literal arrays, so every value sits in one place.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES — these must stay equal to the deployment tool's behaviour.
# ---------------------------------------------------------------------------

# Address plan per tier: (tier, subnet prefix, first host number, subnet CIDR,
# availability zone, request column that holds the instance type).
# The main tier is a single machine at host 5; the other tiers number their
# machines from host 11 upwards.
TIERS = [
    ("main", "10.0.1.", 5, "10.0.1.0/24", "eu-central-1a", "main_instance_type"),
    ("workers", "10.0.1.", 11, "10.0.1.0/24", "eu-central-1a", "workers_instances_type"),
    ("cws1", "10.0.2.", 11, "10.0.2.0/24", "eu-central-1b", "cws_instances_type"),
    ("cws2", "10.0.3.", 11, "10.0.3.0/24", "eu-central-1c", "cws_instances_type"),
]
MAIN_IP = "10.0.1.5"
VPC_CIDR = "10.0.0.0/16"
OPEN_CIDR = "0.0.0.0/0"
MIN_CWS_INSTANCES = 2
REJECT_REASON = "too few CWS instances"

# Ports.
CWS_TARGET_BASE_PORT = 9000
WORKER_BASE_PORT = 26000
CWS_BASE_PORT = 21000
PUBLISHED_SHARDS = 20
# The eleven fixed ports published by every container, in order.
PUBLISHED_FIXED_PORTS = [8888, 8889, 29000, 28000, 28500, 22000, 25000, 21100, 28600, 25123, 27501]

# Ingress rule templates: (rule, security group, protocol, from port,
# to port, cidr source). A to-port of None means 9000 + n*k - 1; a from-port
# of None is sent as absent; source 'admin'/'ssh' names an allow-list.
INGRESS_RULES = [
    (1, "main", "tcp", 13800, 13800, "admin"),
    (2, "main", "tcp", 22, 22, "ssh"),
    (3, "main", "tcp", 9000, None, "admin"),
    (4, "main", "-1", None, -1, VPC_CIDR),
    (5, "lb", "-1", None, -1, OPEN_CIDR),
]

# Service catalogue in document order: (service, section, hosts, port).
# hosts: 'main' = the main machine; 'all' = main, workers, cws1, cws2;
# 'workers_shards' = every worker x worker shard, port + shard;
# 'cws_shards' = every cws1 then cws2 machine x cws shard, port + shard.
SERVICES = [
    ("LogService", "core", "main", 29000),
    ("ResourceService", "core", "all", 28000),
    ("ScoringService", "core", "main", 28500),
    ("Checker", "core", "main", 22000),
    ("EvaluationService", "core", "main", 25000),
    ("Worker", "core", "workers_shards", 26000),
    ("ContestWebServer", "core", "cws_shards", 21000),
    ("AdminWebServer", "core", "main", 21100),
    ("ProxyService", "core", "main", 28600),
    ("PrintingService", "core", "main", 25123),
    ("TestFileCacher", "other", "main", 27501),
]

# Names derived from the deployment id and title.
KEYPAIR_SUFFIX = "_keypair"
PEM_SUFFIX = ".pem"
LB_SUFFIX = "-lb"
TARGET_GROUP_SUFFIX = "-tg"
LB_GROUP_SUFFIX = " - LB"
STATE_FILE_SUFFIX = ".json"
STAMP_FORMAT = "dd-MM-yy-HH'h'mm"

# Container start: default contest, the value that enables the ranking
# server, and the commands started.
DEFAULT_CONTEST = "1"
RWS_ON = "ON"
RANKING_COMMAND = "cmsRankingWebServer"
LOG_COMMAND = "cmsLogService"
RESOURCE_COMMAND = "cmsResourceService"
SHELL_COMMAND = "/bin/bash"

# ---------------------------------------------------------------------------
# FIXED VALUES — configuration generation.
# ---------------------------------------------------------------------------

# Required keys, in the order they are checked.
REQUIRED_CONFIG_KEYS = ["core_services", "other_services", "db_passwd"]

# Keys forced by the planner over anything the user passed (value computed
# from the request, see operators.config.forced_config).
FORCED_CONFIG_KEYS = [
    "core_services",
    "other_services",
    "contest_listen_address",
    "contest_listen_port",
    "num_proxies_used",
    "admin_listen_port",
]
FORCED_NUM_PROXIES = 1
FORCED_ADMIN_LISTEN_PORT = 13800

# Known keys: (key, default as JSON text, kind). Kinds: 'raw' keeps the
# value as given; 'bool' is true only for the string "True"; 'int' is an
# integer conversion that fails on malformed text; 'required' must be given;
# 'local' feeds the database URL or the ranking document and is written only
# when the user gave it; 'secret' is generated when absent (reported, never
# generated here); 'computed' is always replaced.
CONFIG_KEYS = [
    ("temp_dir", '"/tmp"', "raw"),
    ("backdoor", "false", "bool"),
    ("core_services", None, "required"),
    ("other_services", None, "required"),
    ("db_user", '"cmsuser"', "local"),
    ("db_passwd", None, "required"),
    ("db_host", '"localhost"', "local"),
    ("db_port", "5432", "local"),
    ("db_name", '"cmsdb"', "local"),
    ("database", None, "computed"),
    ("database_debug", "false", "bool"),
    ("twophase_commit", "false", "bool"),
    ("keep_sandbox", "false", "bool"),
    ("max_file_size", "10240", "int"),
    ("secret_key", None, "secret"),
    ("tornado_debug", "false", "bool"),
    ("contest_listen_address", '[""]', "raw"),
    ("contest_listen_port", "[8888]", "raw"),
    ("cookie_duration", "10800", "int"),
    ("submit_local_copy", "false", "bool"),
    ("submit_local_copy_path", '"%s/submissions/"', "raw"),
    ("num_proxies_used", "0", "int"),
    ("max_submission_length", "100000", "int"),
    ("max_input_length", "5000000", "int"),
    ("stl_path", '"/usr/share/doc/stl-manual/html/"', "raw"),
    ("admin_listen_address", '""', "raw"),
    ("admin_listen_port", "8889", "int"),
    ("admin_cookie_duration", "36000", "int"),
    ("rankings_user", '"cmsrankingsuser"', "local"),
    ("rankings_passwd", None, "secret"),
    ("rankings_host", '"localhost"', "local"),
    ("rankings_port", "8890", "local"),
    ("rankings", "[]", "computed"),
    ("https_certfile", "null", "raw"),
    ("max_print_length", "10000000", "int"),
    ("printer", "null", "raw"),
    ("paper_size", '"A4"', "raw"),
    ("max_pages_per_job", "10", "int"),
    ("max_jobs_per_user", "10", "int"),
    ("pdf_printing_allowed", "false", "bool"),
]
DATABASE_URL_PARTS = ["db_user", "db_passwd", "db_host", "db_port", "db_name"]
# Ranking document: (key, source config key or None for a constant).
RANKING_FIELDS = [
    ("bind_address", None),
    ("http_port", "rankings_port"),
    ("username", "rankings_user"),
    ("password", "rankings_passwd"),
]
RANKING_BIND_ADDRESS = '""'
SECRET_KEYS = ["secret_key", "rankings_passwd"]
MASKED_KEYS = ["db_passwd", "rankings_passwd", "secret_key"]
MASK = "********"

# ---------------------------------------------------------------------------
# FIXED VALUES — saved state and teardown.
# ---------------------------------------------------------------------------

# The 27 keys of the saved state record, numbered 1..27, with their type.
STATE_KEYS = [
    ("main_instance_ip", "string"),
    ("workers_instance_ips", "array<string>"),
    ("cws1_instance_ips", "array<string>"),
    ("cws2_instance_ips", "array<string>"),
    ("vpc_id", "string"),
    ("gateway_id", "string"),
    ("main_subnet_id", "string"),
    ("main_route_table_id", "string"),
    ("main_route_table_association_id", "string"),
    ("cws1_subnet_id", "string"),
    ("cws1_route_table_id", "string"),
    ("cws1_route_table_association_id", "string"),
    ("cws2_subnet_id", "string"),
    ("cws2_route_table_id", "string"),
    ("cws2_route_table_association_id", "string"),
    ("security_group_id", "string"),
    ("keypair_name", "string"),
    ("main_instance_id", "string"),
    ("worker_instances_ids", "array<string>"),
    ("cws1_instances_ids", "array<string>"),
    ("cws2_instances_ids", "array<string>"),
    ("instances_ips", "array<struct<public:string,private:string>>"),
    ("lb_security_group_id", "string"),
    ("load_balancer_arn", "string"),
    ("load_balancer_dnsname", "string"),
    ("target_group_arn", "string"),
    ("listener_arn", "string"),
]
STATE_KEY_NAMES = [k for k, _ in STATE_KEYS]

# Keys whose presence the load-balancer stage requires, in check order.
LB_PREREQUISITES = ["vpc_id", "cws1_subnet_id", "cws2_subnet_id", "cws1_instances_ids", "cws2_instances_ids"]

# Machines terminated by teardown steps 1-4: (step, state key, is a list).
TERMINATE_KEYS = [
    (1, "worker_instances_ids", True),
    (2, "cws1_instances_ids", True),
    (3, "cws2_instances_ids", True),
    (4, "main_instance_id", False),
]

# Teardown steps in execution order: (step, guard keys, keys removed in
# order, action). Guard None means "any machine id was queued" (step 5).
TEARDOWN_STEPS = [
    (1, ["worker_instances_ids"], ["worker_instances_ids"], "stop workers"),
    (2, ["cws1_instances_ids"], ["cws1_instances_ids"], "stop cws1 machines"),
    (3, ["cws2_instances_ids"], ["cws2_instances_ids"], "stop cws2 machines"),
    (4, ["main_instance_id"], ["main_instance_id"], "stop main machine"),
    (5, None,
     ["main_instance_ip", "workers_instance_ips", "cws1_instance_ips", "cws2_instance_ips", "instances_ips"],
     "wait for stopped machines"),
    (6, ["listener_arn"], ["listener_arn"], "drop listener"),
    (7, ["load_balancer_arn"], ["load_balancer_arn", "load_balancer_dnsname"], "drop load balancer"),
    (8, ["target_group_arn"], ["target_group_arn"], "drop target group"),
    (9, ["lb_security_group_id"], ["lb_security_group_id"], "drop balancer group"),
    (10, ["security_group_id"], ["security_group_id"], "drop machine group"),
    (11, ["main_subnet_id"], ["main_subnet_id", "main_route_table_association_id"], "drop main subnet"),
    (12, ["cws1_subnet_id"], ["cws1_subnet_id", "cws1_route_table_association_id"], "drop cws1 subnet"),
    (13, ["cws2_subnet_id"], ["cws2_subnet_id", "cws2_route_table_association_id"], "drop cws2 subnet"),
    (14, ["main_route_table_id"], ["main_route_table_id"], "drop main routes"),
    (15, ["cws1_route_table_id"], ["cws1_route_table_id"], "drop cws1 routes"),
    (16, ["cws2_route_table_id"], ["cws2_route_table_id"], "drop cws2 routes"),
    (17, ["gateway_id", "vpc_id"], ["gateway_id"], "drop gateway"),
    (18, ["vpc_id"], ["vpc_id"], "drop network"),
    (19, ["keypair_name"], ["keypair_name"], "drop key pair"),
]

# State keys that hold addresses or names rather than cloud resources; they
# are not counted as leaks.
NON_RESOURCE_KEYS = [
    "main_instance_ip",
    "workers_instance_ips",
    "cws1_instance_ips",
    "cws2_instance_ips",
    "instances_ips",
    "load_balancer_dnsname",
]

# ---------------------------------------------------------------------------
# FIXED VALUES — logs.
# ---------------------------------------------------------------------------

LOG_STATUSES = ["info", "success", "warning", "danger", "critical"]
# Terminal style per status: (status, label, foreground, background, bold).
LOG_STYLES = [
    ("info", "Info", "blue", None, False),
    ("success", "Success", "green", None, False),
    ("warning", "Warning", "red", None, False),
    ("danger", "Danger", "white", "on_red", False),
    ("critical", "Critical", "red", None, True),
]
LOG_TIME_COLOR = "yellow"
# Header of a log record: optional text glued before it (a prompt), the ISO
# time with an optional microsecond part, the status word, the message. (?s):
# a message may hold any character, carriage returns and Unicode line
# separators included.
LOG_HEADER_START = r"(?s)^.*?\[\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{6})?\] \w+: "
LOG_HEADER_PATTERN = (
    r"(?s)^(.*?)\[(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{6})?)\] (\w+): (.*)$"
)
