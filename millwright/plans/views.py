"""The views of ``adapters`` in DuckDB SQL, and the assembly of statements that use them."""

from __future__ import annotations

import re

VIEWS = {
    "v_tasks": """
        select event_id as task_id, user_id as node_id, 'f' || (event_id % 500) as file,
            case event_type when 'error' then 'failed' when 'view' then 'cancelled' else 'completed' end as status,
            sched - (event_id % 7) * 1000000 as created_us, case when event_id % 50 <> 0 then sched end as scheduled_us, started as started_us, done as completed_us,
            event_id % 8 as algorithm, strftime(ts, '%Y-%m-%d') as build_id
        from (select *, epoch_us(ts) as done, epoch_us(ts) - cast(round(value * 60000000) as bigint) as started, epoch_us(ts) - cast(round(value * 60000000) as bigint) - (event_id % 60) * 1000000 as sched from events)""",
    "v_decisions": """
        select event_id as task_id, user_id as node_id, event_id % 8 as algorithm, (event_id % 100) / 100 as confidence, epoch_us(ts) as decided_us, props as factors, 1 as attempt from events
        union all select event_id, user_id, event_id % 8, (event_id % 100) / 100, epoch_us(ts) + 1000000, props, 2 from events where event_id % 10 = 0""",
    "v_nodes": """
        select s_suppkey as node_id, s_name as hostname, case s_suppkey % 3 when 0 then 8 when 1 then 4 else 2 end as slots,
            cast(case s_suppkey % 3 when 0 then 2.0 when 1 then 1.0 else 0.5 end as double) as weight, cast(floor(abs(s_acctbal)) as bigint) % 300 as latency_ms from supplier""",
    "v_node_metrics": "select event_id as sample_id, user_id as node_id, cast(floor(value) as bigint) % 100 as cpu, event_id % 97 as memory, event_id % 9 as load, epoch_us(ts) as at_us from events",
    "v_server_stats": """
        select event_id as id, user_id as node_id, case event_type when 'click' then 'COMPILE_OK' when 'error' then 'COMPILE_ERROR' when 'view' then 'TCP_ACCEPT' when 'signup' then 'REJ_OVERLOAD' when 'purchase' then 'COMPILE_TIMEOUT' end as kind,
            epoch_us(ts) as stopped_us, epoch_us(ts) - cast(round(value * 1000000) as bigint) as started_us, value as seconds, 'f' || (event_id % 500) as file from events""",
    "v_file_times": "select l_linestatus as backend, l_partkey as file, round(avg(l_quantity), 6) as seconds from lineitem group by 1, 2",
    "v_run_results": "select l_returnflag as algo, l_linestatus as run, l_suppkey as node, count(*) as tasks, round(sum(l_quantity), 2) as elapsed from lineitem group by 1, 2, 3",
    "v_failures": "select l_linestatus as mode, p_brand as module, l_partkey as file, l_returnflag = 'R' as failed from lineitem join part on l_partkey = p_partkey",
    "v_vertices": "select p_partkey % 7 as graph_id, p_partkey as id, ['compile', 'link', 'gen', 'compile', 'compile'][p_partkey % 5 + 1] as node_type, cast(p_size as bigint) as weight from part",
    "v_edges": """
        select distinct g as graph_id, src, dst from (select p_partkey % 7 as g, p_partkey as dst, unnest([7 * (p_partkey // 7 // 2) + p_partkey % 7, 7 * (p_partkey // 7 // 3) + p_partkey % 7]) as src from part where p_partkey // 7 >= 1)
        where src <> dst""",
    "v_schedule": "select p_partkey as task_id, p_partkey % 10 as machine, p_partkey * 3 % 1000 as start, p_partkey * 3 % 1000 + p_size as \"end\" from part",
    "v_sources": """
        select doc_id as file_id, '/root/' || source || '/' || lang || '/d' || doc_id || '.cpp' as path, body as text, strlen(body) as size
        from (select *, '#include "d' || (doc_id // 2) || '.h"' || chr(10) || '#include <d' || (doc_id // 3) || '.h>' || chr(10) || coalesce(text, '') as body from documents)""",
    "v_headers": """
        select doc_id as file_id, '/root/inc/' || lang || '/d' || doc_id || '.h' as path from documents where doc_id % 3 <> 2
        union all select doc_id, '/root/' || source || '/' || lang || '/near/d' || doc_id || '.h' from documents where doc_id % 4 = 0
        union all select doc_id, '/root/common/d' || doc_id || '.h' from documents where doc_id % 5 = 0
        union all select doc_id, '/root/inc/' || lang || '/sub/n' || doc_id || '.h' from documents where doc_id % 2 = 0
        union all select doc_id, '/root/common/sub/n' || doc_id || '.h' from documents where doc_id % 3 = 0""",
    "v_includers": """
        select doc_id as file_id, '/root/' || source || '/' || lang || '/d' || doc_id || '.cpp' as path, '#include "sub/n' || (doc_id // 4) || '.h"' || chr(10) || '#include "d' || (doc_id // 2) || '.h"' || chr(10) || '#include <d' || (doc_id // 3) || '.h>' || chr(10) || coalesce(text, '') as text,
            case when doc_id % 2 = 0 then ['/root/common', '/root/inc/' || lang] else ['/root/inc/' || lang, '/root/inc/en', '/root/common'] end as search from documents""",
    "v_units": """
        select p_partkey as unit_id, '/root/w' || (p_partkey % 3) as directory, file, ['g++', '-I', 'inc/a' || (p_partkey % 5), '-Iinc/b' || (p_partkey % 3), '-DX=' || p_size, '-O' || (p_partkey % 4), '-c', file, '-o', 'out/f' || p_partkey || '.o'] as arguments
        from (select *, 'src/m' || (p_partkey % 20) || '/f' || p_partkey || ['.c', '.cpp', '.cu', '.cc'][p_partkey % 4 + 1] as file from part)""",
    "v_log": """
        select event_id as line_no, strftime(ts, '%Y-%m-%d %H:%M:%S') || ',' || lpad(cast(epoch_us(ts) // 1000 % 1000 as varchar), 3, '0') || ' - scheduler - INFO - ' ||
            case event_type when 'click' then 'Task compile:f' || event_id || ' completed in ' || printf('%.2f', value) || 's on node' || user_id
                when 'error' then 'Task compile:f' || event_id || ' failed: exit code ' || (event_id % 4)
                when 'view' then 'Task compile:f' || event_id || ' scheduled to node' || user_id
                when 'signup' then 'Task compile:f' || event_id || ' started on node' || user_id
                else 'Heartbeat from node' || user_id end as line
        from events""",
}


def statement(body: str) -> str:
    """``body`` behind the definitions of the views that it names; its own WITH goes on after theirs."""
    body = body.replace("count_if(", "count(*) filter (where ")  # a long, as Spark's
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", body)]
    if not used:
        return body
    body = body.strip()
    recursive = bool(re.match(r"with\s+recursive\b", body, re.I))
    views = ", ".join(f"{v} as ({VIEWS[v].strip()})" for v in used)
    head = f"with {'recursive ' if recursive else ''}{views}"
    rest = re.sub(r"^with\s+(recursive\s+)?", "", body, flags=re.I)
    return f"{head}, {rest}" if rest != body else f"{head} {body}"
