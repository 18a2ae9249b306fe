"""Rule tables that a new installation starts with. Patterns are fixed values; the wording is ours."""

from __future__ import annotations

from ..schema import Rule

# Identifiers, storage types, severities and patterns of the fault rules.
DEFAULT_RULES = [
    Rule("rule_ceph_001", "Ceph OSD down or crashed", "Ceph", "FATAL", r"(?i)(osd down|osd\.[0-9]+ marked down|Assertion failure|SIGSEGV|Segmentation fault|heartbeat_check: no reply)", description="An OSD daemon left the cluster or crashed.", suggestion="Look at the OSD log and its disk, then restart the daemon."),
    Rule("rule_ceph_002", "Ceph slow requests", "Ceph", "CRITICAL", r"(?i)([0-9]+ slow requests|slow request [0-9]+\.[0-9]+s|requests are blocked|slow request.*initiated.*currently)", description="Requests wait too long.", suggestion="Check disk latency and the network between OSDs."),
    Rule("rule_ceph_003", "Ceph placement groups not clean", "Ceph", "WARNING", r"(?i)(pgs? (degraded|stuck|peering|undersized|inconsistent|incomplete))", description="Placement groups are not clean.", suggestion="Watch recovery; repair inconsistent groups."),
    Rule("rule_hdfs_001", "HDFS DataNode lost", "HDFS", "CRITICAL", r"(?i)(DataNode.*is dead|Heartbeat expired|Lost contact with DataNode|Failed to connect to.*DataNode)", description="A DataNode does not answer.", suggestion="Check the node and its network."),
    Rule("rule_hdfs_002", "HDFS corrupt or missing blocks", "HDFS", "FATAL", r"(?i)(Corrupt block|MISSING BLOCKS|Block.*is CORRUPT|ChecksumException|Checksum mismatch)", description="Blocks are damaged or gone.", suggestion="Run fsck and restore from replicas."),
    Rule("rule_minio_001", "MinIO drive or quorum fault", "MinIO", "CRITICAL", r"(?i)(drive.*offline|Disk.*unresponsive|Unable to read xl\.meta|Erasure quorum compromised|corrupted backend)", description="Drives are offline or quorum is at risk.", suggestion="Replace the drive and heal the set."),
    Rule("rule_io_001", "Block device I/O error", "Generic", "FATAL", r"(?i)(Buffer I/O error|I/O error, dev|blk_update_request: I/O error|SCSI error.*medium or hardware error|ext4_lookup.*error|XFS.*error 5)", description="The kernel reports failed I/O.", suggestion="Check the disk's health and replace it."),
    Rule("rule_io_002", "File system turned read-only", "Generic", "CRITICAL", r"(?i)(Read-only file system|Remounting filesystem read-only|Journal commit I/O error|EXT4-fs error)", description="A file system protects itself.", suggestion="Check the disk, then repair and remount."),
    Rule("rule_io_003", "Network or quorum trouble", "Generic", "WARNING", r"(?i)(split-brain|network partition|heartbeat lost|connection reset by peer|no route to host|quorum lost)", description="Members cannot reach each other.", suggestion="Check links and switches."),
    Rule("rule_dist_oom_001", "Process killed for memory", "DistributedSystem", "FATAL", r"(?i)(Out of memory: Kill process|invoked oom-killer|Killed process.*total-vm|Memory cgroup out of memory)", description="The kernel killed a process.", suggestion="Raise memory or lower the load."),
    Rule("rule_dist_panic_002", "Process panic", "DistributedSystem", "FATAL", r"(?i)(fatal error: concurrent map|fatal error: all goroutines are asleep - deadlock|panic: runtime error|SIGSEGV: segmentation violation|Core dumped)", description="A service crashed.", suggestion="Keep the dump and report it."),
    Rule("rule_dist_jvm_003", "JVM memory trouble", "DistributedSystem", "CRITICAL", r"(?i)(java\.lang\.OutOfMemoryError|GC overhead limit exceeded|Metaspace|Java heap space|Full GC.*[0-9]+\.[0-9]+ secs)", description="A JVM runs out of memory.", suggestion="Size the heap and look for leaks."),
    Rule("rule_dist_consensus_004", "Consensus leader change", "DistributedSystem", "CRITICAL", r"(?i)(raft:.*election timeout|leader election lost|new leader elected|lost leader lease|etcdserver: leader changed)", description="The leader changed.", suggestion="Check latency between members."),
    Rule("rule_dist_pool_005", "Connection pool pressure", "DistributedSystem", "WARNING", r"(?i)(connection pool (exhausted|timeout|full)|too many open connections|Connection reset by peer|connection refused|timeout waiting for idle object)", description="Connections run short.", suggestion="Size the pool and find slow calls."),
    Rule("rule_dist_net_006", "Name, TLS or dial fault", "DistributedSystem", "WARNING", r"(?i)(Name or service not known|i/o timeout.*dial tcp|x509: certificate has expired|remote error: tls: bad certificate|SSL handshake failed)", description="Endpoints cannot be reached safely.", suggestion="Check names, clocks and certificates."),
]

# Noise rules.
NOISE_RULES = [
    ("NOISE-001", "lease or config default", r"(?i)(lease file not found.*creating new one|config.*not found.*using defaults?)"),
    ("NOISE-002", "probe disconnect", r"(?i)(connection reset by peer.*during (health_?check|probe)|probe disconnected)"),
    ("NOISE-003", "idle connection closed", r"(?i)(broken pipe.*closing idle connection|idle connection closed)"),
    ("NOISE-004", "missing temporary file", r"(?i)(metric stat directory /tmp/.* does not exist|temp file.*already removed)"),
]

# Workflows and their stages in order.
WORKFLOWS = [
    ("WRITE_DATA_FLOW", [
        ("ALLOC_CHUNK", r"(?i)(allocated? chunk|locate chunk.*success)"),
        ("FORWARD_PRIMARY", r"(?i)(dispatch.*to primary|primary received write)"),
        ("PEER_WAL_COMMIT", r"(?i)(peer wal.*done|replica.*commit.*ok)"),
        ("QUORUM_ACK", r"(?i)(quorum reached|quorum ack|majority committed)"),
        ("ACK_CLIENT", r"(?i)(client write.*success|send ack to client)"),
    ]),
    ("FAILOVER_FLOW", [
        ("HEARTBEAT_TIMEOUT", r"(?i)(heartbeat lost|heartbeat timeout|ping failed)"),
        ("BUMP_VER", r"(?i)(bump.*epoch|bump.*version|mark.*down)"),
        ("TRIGGER_RECOVERY", r"(?i)(trigger recovery|start backfill|rebalance)"),
    ]),
]

# Glossary terms and the texts that stand for them.
GLOSSARY = [
    ("CHUNK_SEAL", ["failed to seal chunk", "seal chunk timeout", "CHUNK_SEAL_TIMEOUT", "chunk seal failed"]),
    ("BUMP_VER", ["bump epoch", "bump map version", "BUMP_VER", "epoch bumped to"]),
    ("PEER_WAL_COMMIT", ["peer wal commit timeout", "waiting for peer wal", "PEER_WAL_COMMIT", "peer ack timeout"]),
    ("MDS_LEASE", ["mds lease expired", "lease renew timeout", "MDS_LEASE_LOST", "subtree lease lost"]),
    ("QUORUM_ACK", ["quorum ack failed", "waiting for quorum", "quorum not reached", "QUORUM_TIMEOUT"]),
]
