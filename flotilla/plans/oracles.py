"""DuckDB oracle SQL for the registered queries.

Each oracle starts from the fixture SQL of FIXTURES.md over the driver's
views and computes the answer the SQL way (``unnest(range(..))``,
``row_number()``, ``string_agg``), independently of the Spark code, which
uses closed forms and array generators instead.
"""

from __future__ import annotations

FIXTURE_CTES = {
    "deployment_requests": """
select o_orderkey as deployment_id, concat('d', o_orderkey) as id,
       concat('Contest ', o_orderkey) as title,
       cast(o_orderkey % 5 as int) as nb_workers_instances,
       cast(1 + o_custkey % 3 as int) as nb_workers_per_instance,
       cast(o_custkey % 7 as int) as nb_cws_instances,
       cast(1 + o_orderkey % 4 as int) as nb_cws_per_instance,
       o_orderstatus <> 'F' as config_phase,
       case when o_orderpriority in ('1-URGENT', '2-HIGH') then 't2.large' else 't2.medium' end
         as main_instance_type,
       concat('c5.', case o_custkey % 3 when 0 then 'large' when 1 then 'xlarge' else '2xlarge' end)
         as workers_instances_type,
       case when o_orderkey % 2 = 0 then 't2.small' else 't2.micro' end as cws_instances_type,
       cast(o_custkey % 4 as int) as cms_contest,
       o_orderdate as requested_at
from orders""",
    "allowed_cidrs": """
select o_orderkey as deployment_id, kind, pos,
       concat('10.', o_custkey % 256, '.', pos, '.0/24') as cidr
from orders cross join (values ('admin', 0), ('admin', 1), ('ssh', 0), ('ssh', 1)) t(kind, pos)
where pos < o_orderkey % 3""",
    "config_overrides": """
select deployment_id, key, max(value) as value
from (select l_orderkey as deployment_id,
             case l_linenumber when 1 then 'backdoor' when 2 then 'database_debug'
               when 3 then 'max_file_size' when 4 then 'num_proxies_used'
               when 5 then 'db_passwd' when 6 then 'paper_size' else 'shard_note' end as key,
             case when l_linenumber in (1, 2)
                  then case l_returnflag when 'R' then 'True' when 'A' then 'true' else 'False' end
                  when l_linenumber in (3, 4) then concat('', l_partkey)
                  else concat('v', l_suppkey) end as value
      from lineitem) x
group by deployment_id, key""",
    "state_entries": """
select o_orderkey as deployment_id, state_key,
       case when state_key = 'worker_instances_ids' and o_orderkey % 5 = 0 then '[]'
            when key_no in (19, 20, 21)
            then concat('["i-', o_orderkey, '-', key_no, '-0","i-', o_orderkey, '-', key_no, '-1"]')
            else concat(state_key, '-', o_orderkey) end as state_value
from orders cross join (values
  ('main_instance_ip', 1), ('workers_instance_ips', 2), ('cws1_instance_ips', 3),
  ('cws2_instance_ips', 4), ('vpc_id', 5), ('gateway_id', 6), ('main_subnet_id', 7),
  ('main_route_table_id', 8), ('main_route_table_association_id', 9), ('cws1_subnet_id', 10),
  ('cws1_route_table_id', 11), ('cws1_route_table_association_id', 12), ('cws2_subnet_id', 13),
  ('cws2_route_table_id', 14), ('cws2_route_table_association_id', 15), ('security_group_id', 16),
  ('keypair_name', 17), ('main_instance_id', 18), ('worker_instances_ids', 19),
  ('cws1_instances_ids', 20), ('cws2_instances_ids', 21), ('instances_ips', 22),
  ('lb_security_group_id', 23), ('load_balancer_arn', 24), ('load_balancer_dnsname', 25),
  ('target_group_arn', 26), ('listener_arn', 27)) t(state_key, key_no)
where (o_orderkey + key_no) % 9 <> 0""",
    "teardown_outcomes": """
select o_orderkey as deployment_id, step, (o_custkey + step) % 4 <> 0 as ok
from orders cross join (values (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11),
  (12), (13), (14), (15), (16), (17), (18), (19)) t(step)""",
    "observed_addresses": """
select o_orderkey as deployment_id, launch_pos,
       concat('3.', o_orderkey % 200, '.', launch_pos, '.7') as public_ip,
       concat('10.9.', o_orderkey % 200, '.', launch_pos) as private_ip
from orders cross join (values (0), (1), (2), (3), (4), (5), (6), (7), (8), (9), (10)) t(launch_pos)
where (o_orderkey + launch_pos) % 6 <> 0""",
    "interface_groups": """
select concat('eni-', p_partkey) as ni_id, concat('lb_security_group_id-', p_partkey % 500) as group_id
from part
union
select concat('eni-', p_partkey), concat('lb_security_group_id-', p_size * 10) from part""",
    "log_records": """
select user_id as deployment_id, event_id as seq, ts,
       case event_type when 'click' then 'info' when 'view' then 'success'
         when 'purchase' then 'warning' when 'error' then 'danger' else 'critical' end as status,
       case when event_id % 10 = 0
            then concat('Brief summary:', chr(10), '  + 1 main instance', chr(10), '  = ', event_id,
                        ' instances')
            when event_id % 40 = 3 then concat(props, chr(13), 'pull 100%')
            when event_id % 40 = 7 then concat(props, chr(8232), 'second part')
            else props end as message
from events""",
    "log_lines": """
select deployment_id, seq, 0 as sub_no,
       concat(case when seq % 25 = 1 then 'Is your IP authorized? [Y/n]' else '' end,
              '[', strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '] ', status, ': ',
              case when seq % 10 = 0 then 'Brief summary:' else message end) as line
from log_records
union all
select deployment_id, seq, 1, '  + 1 main instance' from log_records where seq % 10 = 0
union all
select deployment_id, seq, 2, concat('  = ', seq, ' instances') from log_records where seq % 10 = 0""",
    "contest_env": """
select c_custkey as host_id,
       case c_custkey % 5 when 0 then null when 1 then '' when 2 then '0' when 3 then 'abc'
         else concat('', c_custkey) end as cms_contest,
       case c_custkey % 4 when 0 then null when 1 then 'ON' when 2 then 'on' else 'OFF' end as cms_rws
from customer""",
}

# Derived helper views, in dependency order.
HELPER_CTES = {
    "acc": "select * from deployment_requests where nb_cws_instances >= 2",
    "inst": """
select deployment_id, 'main' as tier, 0 as idx, '10.0.1.5' as private_ip, 0 as tier_rank from acc
union all
select deployment_id, 'workers', i, concat('10.0.1.', i + 11), 1
from (select deployment_id, unnest(range(nb_workers_instances)) as i from acc)
union all
select deployment_id, 'cws1', i, concat('10.0.2.', i + 11), 2
from (select deployment_id, unnest(range(nb_cws_instances // 2 + nb_cws_instances % 2)) as i from acc)
union all
select deployment_id, 'cws2', i, concat('10.0.3.', i + 11), 3
from (select deployment_id, unnest(range(nb_cws_instances // 2)) as i from acc)""",
    "inst6": """
select *, cast(row_number() over (partition by deployment_id order by tier_rank, idx) - 1 as int)
  as launch_pos
from inst""",
    "cws_shards": """
select deployment_id, tier, idx, private_ip, s as shard,
       cast(row_number() over (partition by deployment_id order by tier_rank, idx, s) - 1 as int) as seqno
from (select i.deployment_id, tier, idx, private_ip, tier_rank, unnest(range(a.nb_cws_per_instance)) as s
      from inst i join acc a using (deployment_id) where tier in ('cws1', 'cws2'))""",
    "worker_shards": """
select deployment_id, idx, private_ip, s as shard, nb_workers_per_instance as wk
from (select i.deployment_id, idx, private_ip, a.nb_workers_per_instance,
             unnest(range(a.nb_workers_per_instance)) as s
      from inst i join acc a using (deployment_id) where tier = 'workers')""",
    "pports": """
select deployment_id, pos, port from acc cross join (values (0, 8888), (1, 8889), (2, 29000), (3, 28000),
  (4, 28500), (5, 22000), (6, 25000), (7, 21100), (8, 28600), (9, 25123), (10, 27501)) f(pos, port)
union all
select deployment_id, 11 + i, 9000 + i
from (select deployment_id, unnest(range(nb_cws_instances * nb_cws_per_instance)) as i from acc)
union all
select deployment_id, 11 + nb_cws_instances * nb_cws_per_instance + s, 26000 + s from acc, range(20) t(s)
union all
select deployment_id, 31 + nb_cws_instances * nb_cws_per_instance + s, 21000 + s from acc, range(20) t(s)""",
    "endpoints": """
select deployment_id, 'core' as section, 'LogService' as service, 0 as pos, '10.0.1.5' as ip, 29000 as port
from acc
union all
select deployment_id, 'core', 'ResourceService', launch_pos, private_ip, 28000 from inst6
union all select deployment_id, 'core', 'ScoringService', 0, '10.0.1.5', 28500 from acc
union all select deployment_id, 'core', 'Checker', 0, '10.0.1.5', 22000 from acc
union all select deployment_id, 'core', 'EvaluationService', 0, '10.0.1.5', 25000 from acc
union all
select deployment_id, 'core', 'Worker', idx * wk + shard, private_ip, 26000 + shard from worker_shards
union all
select deployment_id, 'core', 'ContestWebServer', seqno, private_ip, 21000 + shard from cws_shards
union all select deployment_id, 'core', 'AdminWebServer', 0, '10.0.1.5', 21100 from acc
union all select deployment_id, 'core', 'ProxyService', 0, '10.0.1.5', 28600 from acc
union all select deployment_id, 'core', 'PrintingService', 0, '10.0.1.5', 25123 from acc
union all select deployment_id, 'other', 'TestFileCacher', 0, '10.0.1.5', 27501 from acc""",
}



def _pystr(v: str) -> str:
    """Python's str() of a decoded JSON scalar, as an inline SQL expression."""
    return (f"(case when {v} = 'null' then 'None' when {v} = 'true' then 'True' "
            f"when {v} = 'false' then 'False' else json_extract_string({v}, '$') end)")


# Configuration helper views (SQL side: joins where the Spark side unions
# and aggregates).
HELPER_CTES.update({
    "ov": "select deployment_id, key, coalesce(to_json(value)::varchar, 'null') as value from config_overrides",
    "svc": """
select * from (values ('LogService', 0, 'core'), ('ResourceService', 1, 'core'), ('ScoringService', 2, 'core'),
  ('Checker', 3, 'core'), ('EvaluationService', 4, 'core'), ('Worker', 5, 'core'),
  ('ContestWebServer', 6, 'core'), ('AdminWebServer', 7, 'core'), ('ProxyService', 8, 'core'),
  ('PrintingService', 9, 'core'), ('TestFileCacher', 10, 'other')) t(service, ord, section)""",
    "svc_lists": """
select deployment_id, service,
       '[' || string_agg('["' || ip || '",' || port || ']', ',' order by pos) || ']' as lst
from endpoints group by deployment_id, service""",
    "svc_docs": """
select a.deployment_id, s.section,
       '{' || string_agg('"' || s.service || '":' || coalesce(l.lst, '[]'), ',' order by s.ord) || '}' as doc
from acc a cross join svc s
left join svc_lists l on l.deployment_id = a.deployment_id and l.service = s.service
group by a.deployment_id, s.section""",
    "listen_json": """
select deployment_id, '[' || string_agg('"' || private_ip || '"', ',' order by seqno) || ']' as addr_json,
       '[' || string_agg(cast(9000 + seqno as varchar), ',' order by seqno) || ']' as port_json
from cws_shards group by deployment_id""",
    "forced": """
select deployment_id, section || '_services' as key, doc as value from svc_docs
union all
select a.deployment_id, 'contest_listen_address', coalesce(l.addr_json, '[]')
from acc a left join listen_json l using (deployment_id)
union all
select a.deployment_id, 'contest_listen_port', coalesce(l.port_json, '[]')
from acc a left join listen_json l using (deployment_id)
union all select deployment_id, 'num_proxies_used', '1' from acc
union all select deployment_id, 'admin_listen_port', '13800' from acc""",
    "merged": """
select * from ov where key not in ('core_services', 'other_services', 'contest_listen_address',
  'contest_listen_port', 'num_proxies_used', 'admin_listen_port')
  and deployment_id in (select deployment_id from acc)
union all select * from forced""",
    "cat": """
select * from (values
  ('temp_dir', '"/tmp"', 'raw'),
  ('backdoor', 'false', 'bool'),
  ('core_services', null, 'required'),
  ('other_services', null, 'required'),
  ('db_user', '"cmsuser"', 'local'),
  ('db_passwd', null, 'required'),
  ('db_host', '"localhost"', 'local'),
  ('db_port', '5432', 'local'),
  ('db_name', '"cmsdb"', 'local'),
  ('database', null, 'computed'),
  ('database_debug', 'false', 'bool'),
  ('twophase_commit', 'false', 'bool'),
  ('keep_sandbox', 'false', 'bool'),
  ('max_file_size', '10240', 'int'),
  ('secret_key', null, 'secret'),
  ('tornado_debug', 'false', 'bool'),
  ('contest_listen_address', '[""]', 'raw'),
  ('contest_listen_port', '[8888]', 'raw'),
  ('cookie_duration', '10800', 'int'),
  ('submit_local_copy', 'false', 'bool'),
  ('submit_local_copy_path', '"%s/submissions/"', 'raw'),
  ('num_proxies_used', '0', 'int'),
  ('max_submission_length', '100000', 'int'),
  ('max_input_length', '5000000', 'int'),
  ('stl_path', '"/usr/share/doc/stl-manual/html/"', 'raw'),
  ('admin_listen_address', '""', 'raw'),
  ('admin_listen_port', '8889', 'int'),
  ('admin_cookie_duration', '36000', 'int'),
  ('rankings_user', '"cmsrankingsuser"', 'local'),
  ('rankings_passwd', null, 'secret'),
  ('rankings_host', '"localhost"', 'local'),
  ('rankings_port', '8890', 'local'),
  ('rankings', '[]', 'computed'),
  ('https_certfile', 'null', 'raw'),
  ('max_print_length', '10000000', 'int'),
  ('printer', 'null', 'raw'),
  ('paper_size', '"A4"', 'raw'),
  ('max_pages_per_job', '10', 'int'),
  ('max_jobs_per_user', '10', 'int'),
  ('pdf_printing_allowed', 'false', 'bool')) t(key, dflt, kind)""",
    "filled": """
select a.deployment_id, c.key, c.kind, case when m.key is not null then m.value else c.dflt end as value,
       m.key is not null as present
from acc a cross join cat c left join merged m on m.deployment_id = a.deployment_id and m.key = c.key""",
    "ints": """
select deployment_id, key, value,
       case when value = 'true' then 1::bigint when value = 'false' then 0::bigint
            when starts_with(value, '"') then
              case when regexp_full_match(json_extract_string(value, '$'), '\\s*[+-]?[0-9]+(_[0-9]+)*\\s*')
                   then try_cast(replace(trim(json_extract_string(value, '$')), '_', '') as bigint) end
            when regexp_full_match(value, '-?[0-9]+') then try_cast(value as bigint)
            when regexp_full_match(value, '-?[0-9]+\\.[0-9]+') then cast(trunc(cast(value as double)) as bigint) end as n
from filled where kind = 'int'""",
    "typed": """
select f.deployment_id, f.key, f.kind, f.present,
       case f.kind when 'bool' then case when f.value = '"True"' then 'true' else 'false' end
                   when 'int' then cast(i.n as varchar)
                   else f.value end as v
from filled f left join ints i on i.deployment_id = f.deployment_id and i.key = f.key""",
    "known": """
select deployment_id, key,
       case when key in ('db_passwd', 'rankings_passwd', 'secret_key') and v is not null
            then '"********"' else v end as value,
       case when kind = 'required' and not present then 'missing required key'
            when kind = 'int' and v is null then 'invalid integer' end as error
from typed
where kind in ('raw', 'bool', 'int', 'required') or (kind in ('local', 'secret') and present)
   or key = 'rankings'""",
    "parts": """
select deployment_id,
       max(case when key = 'db_user' then value end) as db_user,
       max(case when key = 'db_passwd' then value end) as db_passwd,
       max(case when key = 'db_host' then value end) as db_host,
       max(case when key = 'db_port' then value end) as db_port,
       max(case when key = 'db_name' then value end) as db_name,
       max(case when key = 'rankings_port' then value end) as rankings_port,
       max(case when key = 'rankings_user' then value end) as rankings_user,
       max(case when key = 'rankings_passwd' then value end) as rankings_passwd
from filled group by deployment_id""",
    "urls": """
select deployment_id,
       'postgresql+psycopg2://' || {pystr_db_user} || ':' || case when db_passwd is not null then '********' end
       || '@' || {pystr_db_host} || ':' || {pystr_db_port} || '/' || {pystr_db_name} as database
from parts""".format(**{f"pystr_{c}": _pystr(c) for c in ("db_user", "db_host", "db_port", "db_name")}),
    "passthrough": """
select * from merged
where key not in (select key from cat) and deployment_id in (select deployment_id from acc)""",
    "entries": """
select deployment_id, key, value, error from known
union all
select deployment_id, 'database', to_json(database)::varchar, null from urls where database is not null
union all
select deployment_id, key, value, null from passthrough""",
})


# State helper views: key by key, the way the teardown reads its record.
HELPER_CTES.update({
    "steps": """
select * from (values
  (1, 'worker_instances_ids', null, 'stop workers'),
  (2, 'cws1_instances_ids', null, 'stop cws1 machines'),
  (3, 'cws2_instances_ids', null, 'stop cws2 machines'),
  (4, 'main_instance_id', null, 'stop main machine'),
  (5, null, null, 'wait for stopped machines'),
  (6, 'listener_arn', null, 'drop listener'),
  (7, 'load_balancer_arn', null, 'drop load balancer'),
  (8, 'target_group_arn', null, 'drop target group'),
  (9, 'lb_security_group_id', null, 'drop balancer group'),
  (10, 'security_group_id', null, 'drop machine group'),
  (11, 'main_subnet_id', null, 'drop main subnet'),
  (12, 'cws1_subnet_id', null, 'drop cws1 subnet'),
  (13, 'cws2_subnet_id', null, 'drop cws2 subnet'),
  (14, 'main_route_table_id', null, 'drop main routes'),
  (15, 'cws1_route_table_id', null, 'drop cws1 routes'),
  (16, 'cws2_route_table_id', null, 'drop cws2 routes'),
  (17, 'gateway_id', 'vpc_id', 'drop gateway'),
  (18, 'vpc_id', null, 'drop network'),
  (19, 'keypair_name', null, 'drop key pair')) t(step, guard1, guard2, action)""",
    "removes": """
select * from (values
  (1, 0, 'worker_instances_ids'), (2, 0, 'cws1_instances_ids'), (3, 0, 'cws2_instances_ids'),
  (4, 0, 'main_instance_id'),
  (5, 0, 'main_instance_ip'), (5, 1, 'workers_instance_ips'), (5, 2, 'cws1_instance_ips'),
  (5, 3, 'cws2_instance_ips'), (5, 4, 'instances_ips'),
  (6, 0, 'listener_arn'), (7, 0, 'load_balancer_arn'), (7, 1, 'load_balancer_dnsname'),
  (8, 0, 'target_group_arn'), (9, 0, 'lb_security_group_id'), (10, 0, 'security_group_id'),
  (11, 0, 'main_subnet_id'), (11, 1, 'main_route_table_association_id'),
  (12, 0, 'cws1_subnet_id'), (12, 1, 'cws1_route_table_association_id'),
  (13, 0, 'cws2_subnet_id'), (13, 1, 'cws2_route_table_association_id'),
  (14, 0, 'main_route_table_id'), (15, 0, 'cws1_route_table_id'), (16, 0, 'cws2_route_table_id'),
  (17, 0, 'gateway_id'), (18, 0, 'vpc_id'), (19, 0, 'keypair_name')) t(step, rpos, key)""",
    "term_ids": """
select deployment_id, step, cast(pos as int) as pos, instance_id from (
  select deployment_id,
         case state_key when 'worker_instances_ids' then 1 when 'cws1_instances_ids' then 2
           else 3 end as step,
         unnest(from_json(state_value, '["VARCHAR"]')) as instance_id,
         generate_subscripts(from_json(state_value, '["VARCHAR"]'), 1) - 1 as pos
  from state_entries
  where state_key in ('worker_instances_ids', 'cws1_instances_ids', 'cws2_instances_ids'))
union all
select deployment_id, 4, 0, state_value from state_entries where state_key = 'main_instance_id'""",
    "plan": """
select s.deployment_id, st.step, st.action
from (select distinct deployment_id from state_entries) s cross join steps st
where (st.step = 5 and exists (select 1 from term_ids t where t.deployment_id = s.deployment_id))
   or (st.step <> 5
       and exists (select 1 from state_entries e where e.deployment_id = s.deployment_id
                   and e.state_key = st.guard1)
       and (st.guard2 is null
            or exists (select 1 from state_entries e where e.deployment_id = s.deployment_id
                       and e.state_key = st.guard2)))""",
    "ran_ok": """
select p.deployment_id, p.step from plan p
join teardown_outcomes o on o.deployment_id = p.deployment_id and o.step = p.step where o.ok""",
    "gaps": """
select r.deployment_id, r.step, min(m.rpos) as first_gap
from ran_ok r join removes m on m.step = r.step
where not exists (select 1 from state_entries e where e.deployment_id = r.deployment_id and e.state_key = m.key)
group by r.deployment_id, r.step""",
    "removed": """
select r.deployment_id, m.key
from ran_ok r join removes m on m.step = r.step
left join gaps g on g.deployment_id = r.deployment_id and g.step = r.step
where g.first_gap is null or m.rpos < g.first_gap""",
    "residual": """
select e.* from state_entries e
where not exists (select 1 from removed r where r.deployment_id = e.deployment_id and r.key = e.state_key)""",
    "leaked": """
select deployment_id, cast(count(*) as int) as leaked from residual
where state_key not in ('main_instance_ip', 'workers_instance_ips', 'cws1_instance_ips', 'cws2_instance_ips',
                        'instances_ips', 'load_balancer_dnsname')
group by deployment_id""",
    "memory": """
select deployment_id, 'main_instance_ip' as state_key, '10.0.1.5' as state_value
from acc where config_phase
union all
select a.deployment_id, t.state_key,
       coalesce((select '[' || string_agg('"' || i.private_ip || '"', ',' order by i.idx) || ']'
                 from inst i where i.deployment_id = a.deployment_id and i.tier = t.tier), '[]')
from acc a cross join (values ('workers_instance_ips', 'workers'), ('cws1_instance_ips', 'cws1'),
                              ('cws2_instance_ips', 'cws2')) t(state_key, tier)
where a.config_phase""",
})

# Log helper views.
HELPER_CTES.update({
    "fmt": """
select deployment_id, seq,
       '[' || strftime(ts, '%Y-%m-%dT%H:%M:%S')
       || case when strftime(ts, '%f') = '000000' then '' else '.' || strftime(ts, '%f') end
       || '] ' || status || ': ' || message as line
from log_records""",
    "numbered": """
select *, sum(case when regexp_matches(line,
                 '^(.*?)\\[(\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}(?:\\.\\d{6})?)\\] (\\w+): (.*)$')
               then 1 else 0 end)
          over (partition by deployment_id order by seq, sub_no rows between unbounded preceding and current row)
          as rec
from log_lines""",
})

ORACLES: dict[str, str] = {}


def _add(name: str, sql: str) -> None:
    ORACLES[name] = sql.strip()


_add("b1_validate_requests", """
select deployment_id, coalesce(nb_cws_instances >= 2, false) as accepted,
       case when coalesce(nb_cws_instances >= 2, false) then null
            else 'too few CWS instances' end as reason
from deployment_requests""")

_add("b2_fleet_summary", """
select deployment_id, 1 as main, nb_workers_instances as workers, nb_cws_instances as cws,
       1 + nb_workers_instances + nb_cws_instances as total
from acc""")

_add("b2_fleet_totals", """
select count(*) as deployments, cast(sum(1) as bigint) as main,
       cast(sum(nb_workers_instances) as bigint) as workers, cast(sum(nb_cws_instances) as bigint) as cws,
       cast(sum(1 + nb_workers_instances + nb_cws_instances) as bigint) as total
from acc""")

_add("b3_split_subnets", """
select deployment_id, cast(nb_cws_instances // 2 + nb_cws_instances % 2 as int) as n_cws1,
       cast(nb_cws_instances // 2 as int) as n_cws2
from acc""")

_add("b4_expand_instances", """
select deployment_id, tier, cast(idx as int) as idx, private_ip from inst""")

_add("b5_place_instances", """
select i.deployment_id, tier, cast(idx as int) as idx, launch_pos, private_ip,
       case when tier in ('main', 'workers') then '10.0.1.0/24' when tier = 'cws1' then '10.0.2.0/24'
            else '10.0.3.0/24' end as subnet_cidr,
       case when tier in ('main', 'workers') then 'eu-central-1a' when tier = 'cws1' then 'eu-central-1b'
            else 'eu-central-1c' end as zone,
       case tier when 'main' then main_instance_type when 'workers' then workers_instances_type
            else cws_instances_type end as instance_type,
       1 as count
from inst6 i join acc a using (deployment_id)""")

_add("b6_launch_order", """
select deployment_id, launch_pos, tier, cast(idx as int) as idx from inst6""")

_add("b7_derive_names", """
select deployment_id, id || '_keypair' as keypair, id || '_keypair.pem' as pem, id || '-lb' as load_balancer,
       id || '-tg' as target_group, title as security_group, title || ' - LB' as lb_security_group,
       id || '.json' as state_file
from acc""")

_add("b8_ingress_rules", """
select c.deployment_id, 'main' as security_group, 1 as rule, 'tcp' as protocol, 13800 as from_port,
       13800 as to_port, cidr
from allowed_cidrs c join acc a on a.deployment_id = c.deployment_id where kind = 'admin'
union all
select c.deployment_id, 'main', 2, 'tcp', 22, 22, cidr
from allowed_cidrs c join acc a on a.deployment_id = c.deployment_id where kind = 'ssh'
union all
select c.deployment_id, 'main', 3, 'tcp', 9000, cast(9000 + nb_cws_instances * nb_cws_per_instance - 1 as int),
       cidr
from allowed_cidrs c join acc a on a.deployment_id = c.deployment_id where kind = 'admin'
union all
select deployment_id, 'main', 4, '-1', cast(null as int), -1, '10.0.0.0/16' from acc
union all
select deployment_id, 'lb', 5, '-1', cast(null as int), -1, '0.0.0.0/0' from acc""")

_add("b9_published_ports", """
select deployment_id, cast(pos as int) as pos, cast(port as int) as port from pports""")

_add("b10_port_flags", """
select deployment_id, string_agg('-p ' || port || ':' || port, ' ' order by pos) as port_flags
from pports group by deployment_id""")

_add("b11_target_registrations", """
select deployment_id, tier, cast(idx as int) as idx, cast(shard as int) as shard, private_ip,
       cast(9000 + seqno as int) as port
from cws_shards""")

_add("b12_service_endpoints", """
select deployment_id, section, service, cast(pos as int) as pos, ip, cast(port as int) as port from endpoints""")

_add("b13_service_document", """
select deployment_id, section, service, cast(pos as int) as pos, ip, cast(port as int) as port from endpoints""")

_add("b14_listen_lists", """
select deployment_id, seqno as pos, private_ip as address, cast(9000 + seqno as int) as port from cws_shards""")

_add("b15_attach_addresses", """
select i.deployment_id, i.launch_pos, tier, cast(idx as int) as idx, i.private_ip, o.public_ip,
       o.private_ip as observed_private_ip
from inst6 i left join observed_addresses o
  on o.deployment_id = i.deployment_id and o.launch_pos = i.launch_pos""")

_OBSERVED = """
with seen as (
  select o.deployment_id, launch_pos, public_ip || k as public_ip, private_ip, k,
         requested_at + to_days(30 * least(k, 2)) as observed_at
  from observed_addresses o join deployment_requests using (deployment_id), range(4) t(k)),
newest as (
  select * from seen {where}
  qualify row_number() over (partition by deployment_id, launch_pos order by observed_at desc, public_ip desc) = 1)
select i.deployment_id, i.launch_pos, tier, cast(idx as int) as idx, i.private_ip, o.public_ip,
       o.private_ip as observed_private_ip
from inst6 i left join newest o on o.deployment_id = i.deployment_id and o.launch_pos = i.launch_pos"""
_add("b15_attach_addresses_as_of", _OBSERVED.format(where="where observed_at <= timestamp '1998-01-01'"))
_add("b15_attach_addresses_newest", _OBSERVED.format(where=""))

_add("b16_deployment_stamp", """
select deployment_id, strftime(requested_at, '%d-%m-%y-%Hh%M') as stamp from acc""")

_add("b17_container_services", """
with e as (select host_id, coalesce(nullif(cms_contest, ''), '1') as contest, cms_rws from contest_env),
f as (select *, coalesce(try_cast(contest as bigint) > 0, false) as runs,
             coalesce(cms_rws = 'ON', false) as rws from e)
select host_id, contest, 'services' as mode, 0 as pos, 'cmsRankingWebServer' as service from f where runs and rws
union all
select host_id, contest, 'services', case when rws then 1 else 0 end, 'cmsLogService' from f where runs
union all
select host_id, contest, 'services', case when rws then 2 else 1 end, 'cmsResourceService' from f where runs
union all
select host_id, contest, 'shell', 0, '/bin/bash' from f where not runs""")


# Variants: the statement of another query with some CTEs exchanged.
OV_TYPED = """
select deployment_id, key,
       case when key in ('backdoor', 'database_debug') and deployment_id % 4 = 0 then 'true'
            when key = 'database_debug' and deployment_id % 4 = 1 then 'null'
            when key = 'max_file_size' and deployment_id % 3 = 0 then value
            when key = 'max_file_size' and deployment_id % 3 = 1 then value || '.75'
            when key = 'max_file_size' and deployment_id % 7 = 2 then '[1]'
            when key = 'paper_size' and deployment_id % 3 = 1 then 'null'
            when key = 'shard_note' and deployment_id % 2 = 0 then '[1,"' || value || '",null]'
            else coalesce(to_json(value)::varchar, 'null') end as value
from config_overrides"""
OV_NESTED = """
select deployment_id, key,
       case when key = 'shard_note' and deployment_id % 4 = 0
            then '{"hosts":[{"ip":"10.0.0.1","ports":[1,2.5,null]}],"note":"' || value || ' é"}'
            when key = 'shard_note' and deployment_id % 4 in (1, 2) then null
            when key = 'paper_size' and deployment_id % 5 = 0 then '{"h":{"mm":297},"w":210}'
            when key = 'paper_size' and deployment_id % 5 = 1 then null
            when key = 'max_file_size' and deployment_id % 6 = 1 then '1000.0'
            when key = 'backdoor' and deployment_id % 7 = 1 then '"True"'
            else coalesce(to_json(value)::varchar, 'null') end as value
from config_overrides"""
# Rows of overrides that are no JSON value are errors of their deployment.
_NESTED = {
    "ov": OV_NESTED,
    "typed": HELPER_CTES["typed"].replace("f.present,", "f.present, f.value as raw,", 1),
    "known": HELPER_CTES["known"].replace("when kind = 'int' and v is null", """when present and raw is null then 'invalid value'
            when kind = 'int' and v is null"""),
    "entries": HELPER_CTES["entries"].replace("select deployment_id, key, value, null from passthrough",
                                              "select deployment_id, key, value, case when value is null then 'invalid value' end from passthrough"),
}
_PLAIN_URLS = HELPER_CTES["urls"].replace("case when db_passwd is not null then '********' end", _pystr("db_passwd"))
_PLAIN_KNOWN = HELPER_CTES["known"].replace("""case when key in ('db_passwd', 'rankings_passwd', 'secret_key') and v is not null
            then '"********"' else v end as value""", "v as value")
VARIANTS = {
    **{f"{base}_typed": (base, {"ov": OV_TYPED}) for base in (
        "c3_strict_bool", "c4_config_int", "c6_passthrough_keys", "c8_ranking_document", "c9_config_entries",
        "c9_config_document")},
    **{f"{base}_nested": (base, _NESTED) for base in (
        "c6_passthrough_keys", "c9_config_entries", "c9_config_document")},
    **{name: (name, _NESTED) for name in ("c9_documents_parse", "a3_config_failures_nested")},
    "c9_config_document_repeated": ("c9_config_document", {}),
    "c7_database_url_unmasked": ("c7_database_url", {"urls": _PLAIN_URLS}),
    "c9_config_entries_unmasked": ("c9_config_entries", {"urls": _PLAIN_URLS, "known": _PLAIN_KNOWN}),
}


def oracle_sql() -> dict[str, str]:
    """Full statements: the fixture and helper CTEs each query uses, then
    the query itself."""
    out = {}
    bodies = {n: (sql, {}) for n, sql in ORACLES.items()}
    bodies.update({n: (ORACLES[base], changed) for n, (base, changed) in VARIANTS.items()})
    for name, (body, exchanged) in bodies.items():
        ctes = {**FIXTURE_CTES, **HELPER_CTES, **exchanged}
        # keep only the CTEs reachable from the body (cheap textual closure)
        keep: list[str] = []
        frontier = body
        changed = True
        while changed:
            changed = False
            for cname, csql in ctes.items():
                if cname not in keep and _mentions(frontier, cname):
                    keep.append(cname)
                    frontier += "\n" + csql
                    changed = True
        ordered = [c for c in ctes if c in keep]
        with_clause = ",\n".join(f"{c} as ({ctes[c]}\n)" for c in ordered)
        if not ordered:
            out[name] = body
        elif body.lower().startswith("with "):
            out[name] = f"with {with_clause},\n{body[5:]}"
        else:
            out[name] = f"with {with_clause}\n{body}"
    return out


def _mentions(sql: str, name: str) -> bool:
    import re
    return re.search(rf"\b{name}\b", sql) is not None

_add("c1_missing_required_raw", """
select deployment_id, first_missing from (
  select a.deployment_id,
         case when not exists (select 1 from ov o where o.deployment_id = a.deployment_id and o.key = 'core_services')
                then 'core_services'
              when not exists (select 1 from ov o where o.deployment_id = a.deployment_id and o.key = 'other_services')
                then 'other_services'
              when not exists (select 1 from ov o where o.deployment_id = a.deployment_id and o.key = 'db_passwd')
                then 'db_passwd' end as first_missing
  from acc a) x
where first_missing is not null""")

_add("c1_missing_required", """
select deployment_id, first_missing from (
  select a.deployment_id,
         case when not exists (select 1 from merged o where o.deployment_id = a.deployment_id and o.key = 'core_services')
                then 'core_services'
              when not exists (select 1 from merged o where o.deployment_id = a.deployment_id and o.key = 'other_services')
                then 'other_services'
              when not exists (select 1 from merged o where o.deployment_id = a.deployment_id and o.key = 'db_passwd')
                then 'db_passwd' end as first_missing
  from acc a) x
where first_missing is not null""")

_add("c2_fill_defaults", "select deployment_id, key, kind, value, present from filled")

_add("c3_strict_bool", """
select deployment_id, key, coalesce(value = '"True"', false) as value from filled where kind = 'bool'""")

_add("c4_config_int", "select deployment_id, key, n as value, n is null as error from ints")

_add("c5_apply_forced", "select deployment_id, key, value from merged")

_add("c6_passthrough_keys", "select deployment_id, key, value from passthrough")

_add("c7_database_url", "select deployment_id, database from urls")

_add("c8_ranking_document", """
select deployment_id, 'bind_address' as key, '""' as value from parts
union all select deployment_id, 'http_port', rankings_port from parts
union all select deployment_id, 'username', rankings_user from parts
union all select deployment_id, 'password', case when rankings_passwd is not null then '"********"' end from parts""")

_add("c8_ranking_config_document", """
select deployment_id,
       '{"bind_address":"","http_port":' || coalesce(rankings_port, 'null') || ',"username":'
       || coalesce(rankings_user, 'null') || ',"password":'
       || coalesce(case when rankings_passwd is not null then '"********"' end, 'null') || '}' as document
from parts""")

_add("c9_config_entries", "select deployment_id, key, value, error from entries")

_add("c9_config_document", """
select deployment_id,
       case when min(error) is null
            then '{' || string_agg(to_json(key)::varchar || ':' || value, ',' order by key) || '}' end as document,
       case when count(*) filter (where error = 'missing required key') > 0 then 'missing required key'
            else min(error) end as error
from entries group by deployment_id""")

_add("c9_documents_parse", """
with docs as (
  select deployment_id, '{' || string_agg(to_json(key)::varchar || ':' || value, ',') || '}' as document
  from entries group by deployment_id having count(error) = 0)
select deployment_id, json_valid(document) as parses, cast(len(json_keys(document)) as bigint) as n_keys,
       json_extract_string(document, '$.shard_note.hosts[0].ip') as ip,
       try_cast(json_extract_string(document, '$.paper_size.h.mm') as double) as mm
from docs""")

_add("c4_config_int_text", """
select deployment_id, key, v as value, v is null as error from (
  select f.deployment_id, f.key,
         case when f.key = 'max_file_size' then case f.deployment_id % 5 when 0 then '123456789012345678901234567890'
                when 1 then '-98765432109876543210' when 2 then '150000000000000000000' when 4 then '10240' end
              else cast(i.n as varchar) end as v
  from filled f left join ints i on i.deployment_id = f.deployment_id and i.key = f.key where f.kind = 'int')""")

_add("c7_database_url_parts", """
select deployment_id, 'postgresql+psycopg2://'
       || case deployment_id % 4 when 0 then '[1, ''a'', None, [2.5, True]]' when 1 then '{''b'': {''x'': []}, ''u'': "it''s"}'
          when 2 then 'cmsuser' else '1e+16' end
       || ':' || case when db_passwd is not null then '********' end || '@'
       || case deployment_id % 2 when 0 then 'h\\x' else '[''h\\n'', ''q"u\\''s'']' end || ':'
       || case deployment_id % 3 when 0 then '5432.5' when 1 then '123456789012345678901234567890' else '5432' end || '/cmsdb' as database
from parts""")

_add("c10_generated_secrets", """
select a.deployment_id, k.key
from acc a cross join (values ('secret_key'), ('rankings_passwd')) k(key)
where not exists (select 1 from merged m where m.deployment_id = a.deployment_id and m.key = k.key)""")

_add("d1_missing_prerequisites", """
select deployment_id, first_missing from (
  select a.deployment_id,
         case when not exists (select 1 from state_entries e where e.deployment_id = a.deployment_id
                               and e.state_key = 'vpc_id') then 'vpc_id'
              when not exists (select 1 from state_entries e where e.deployment_id = a.deployment_id
                               and e.state_key = 'cws1_subnet_id') then 'cws1_subnet_id'
              when not exists (select 1 from state_entries e where e.deployment_id = a.deployment_id
                               and e.state_key = 'cws2_subnet_id') then 'cws2_subnet_id'
              when not exists (select 1 from state_entries e where e.deployment_id = a.deployment_id
                               and e.state_key = 'cws1_instances_ids') then 'cws1_instances_ids'
              when not exists (select 1 from state_entries e where e.deployment_id = a.deployment_id
                               and e.state_key = 'cws2_instances_ids') then 'cws2_instances_ids' end
           as first_missing
  from acc a where not a.config_phase) x
where first_missing is not null""")

_add("d2_instances_to_terminate", "select deployment_id, step, pos, instance_id from term_ids")

_add("d3_teardown_plan", "select deployment_id, step, action from plan")

_add("d4_residual_state", "select deployment_id, state_key, state_value from residual")

_add("d5_leaks", "select deployment_id, leaked from leaked")

_add("d5_leaks_top", "select deployment_id, leaked from leaked order by leaked desc, deployment_id limit 20")

_add("d5_leak_counts_from_residual", "select deployment_id, leaked from leaked")

# Teardowns that end at the listing of interfaces (step 9): the record stays
# as it was, and steps after it do not run.
_NO_LISTING = "select deployment_id from state_entries where state_key = 'lb_security_group_id' and deployment_id % 11 = 0"
_ABORTED = {"removed": HELPER_CTES["removed"].replace(
    "where g.first_gap is null or m.rpos < g.first_gap",
    f"where (g.first_gap is null or m.rpos < g.first_gap) and r.deployment_id not in ({_NO_LISTING})")}
VARIANTS["d4_residual_state_aborted"] = ("d4_residual_state", _ABORTED)
VARIANTS["d4_residual_state_bucketed"] = ("d4_residual_state", {})
VARIANTS["d5_leaks_aborted"] = ("d5_leaks", _ABORTED)

_add("d3_steps_run", f"select * from plan where step <= 9 or deployment_id not in ({_NO_LISTING})")

_add("d5_stale_keys", f"""
select r.deployment_id, r.key as state_key from removed r join removes s on s.key = r.key
where s.step < 9 and r.deployment_id in ({_NO_LISTING})""")

_add("d6_effective_state", """
select deployment_id, state_key, state_value from memory
union all
select deployment_id, state_key, state_value from state_entries
where deployment_id not in (select deployment_id from memory)""")

_add("d7_select_instances", """
select t.deployment_id, t.step, t.pos, t.instance_id from term_ids t
where exists (select 1 from teardown_outcomes o where o.deployment_id = t.deployment_id and o.step = t.step
              and o.ok)""")

_add("a5_interfaces_in_group", """
select distinct e.deployment_id, g.ni_id
from state_entries e join interface_groups g on g.group_id = e.state_value
where e.state_key = 'lb_security_group_id'""")

_add("e1_format_log", "select deployment_id, seq, line from fmt")

_add("e1_format_log_stream", "select deployment_id, seq, line from fmt")

_add("e2_style_log", """
select deployment_id, seq, 'yellow' as time_color,
       case status when 'info' then 'Info' when 'success' then 'Success' when 'warning' then 'Warning'
         when 'danger' then 'Danger' when 'critical' then 'Critical' end as label,
       case status when 'info' then 'blue' when 'success' then 'green' when 'warning' then 'red'
         when 'danger' then 'white' when 'critical' then 'red' end as fg,
       case status when 'danger' then 'on_red' end as bg,
       case when status = 'critical' then true
            when status in ('info', 'success', 'warning', 'danger') then false end as bold
from log_records""")
_add("e2_style_log_stream", """
select deployment_id, seq, 'yellow' as time_color,
       case status when 'info' then 'Info' when 'success' then 'Success' when 'warning' then 'Warning'
         when 'danger' then 'Danger' when 'critical' then 'Critical' end as label,
       case status when 'info' then 'blue' when 'success' then 'green' when 'warning' then 'red'
         when 'danger' then 'white' when 'critical' then 'red' end as fg,
       case status when 'danger' then 'on_red' end as bg,
       case when status = 'critical' then true
            when status in ('info', 'success', 'warning', 'danger') then false end as bold
from log_records""")

_add("e3_assemble_records", """
select deployment_id, cast(rec as bigint) as rec, min(seq) as first_seq,
       string_agg(line, chr(10) order by seq, sub_no) as text
from numbered group by deployment_id, rec""")

_add("e3_assemble_records_chunked", """
select deployment_id, cast(rec as bigint) as rec, min(seq) as first_seq,
       string_agg(line, chr(10) order by seq, sub_no) as text
from numbered group by deployment_id, rec""")

_add("e3_assemble_files", """
select deployment_id, cast(rec as bigint) as rec, min(line_no) as first_line,
       string_agg(line, chr(10) order by line_no) as text
from (select *, row_number() over (partition by deployment_id order by seq, sub_no) as line_no from numbered)
group by deployment_id, rec""")

VARIANTS["e3_assemble_stream"] = ("e3_assemble_records", {})

_add("e3_stream_late_lines", """
with step as (select (max(seq) // 40 + 1) * 10 as s from log_lines),
sliced as (select l.*, (3 * seq + sub_no - 1) // (3 * s) as slice from log_lines l, step),
arrived as (select *, case when seq % 50 = 7 then least(3, slice + 1) else slice end as batch from sliced),
before as (
  select *, max(3 * seq + sub_no) over (partition by deployment_id order by batch range between unbounded preceding and 1 preceding) as last
  from arrived)
select deployment_id, seq, line as text, 'order' as reason from before where 3 * seq + sub_no <= last""")

_add("e4_parse_log", """
select deployment_id, seq, '' as prompt, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as ts, status, message
from log_records""")

_add("e4_parse_log_stream", """
select deployment_id, seq, '' as prompt, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as ts, status, message
from log_records""")

_add("e4_parse_assembled", """
select deployment_id,
       cast(row_number() over (partition by deployment_id order by seq) as bigint) as rec,
       seq as first_seq,
       case when seq % 25 = 1 then 'Is your IP authorized? [Y/n]' else '' end as prompt,
       strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as ts, status, message
from log_records""")

_add("e5_status_counts", """
select deployment_id,
       count(*) filter (where status = 'info') as info,
       count(*) filter (where status = 'success') as success,
       count(*) filter (where status = 'warning') as warning,
       count(*) filter (where status = 'danger') as danger,
       count(*) filter (where status = 'critical') as critical
from log_records group by deployment_id""")
_add("e5_status_counts_stream", """
select deployment_id,
       count(*) filter (where status = 'info') as info,
       count(*) filter (where status = 'success') as success,
       count(*) filter (where status = 'warning') as warning,
       count(*) filter (where status = 'danger') as danger,
       count(*) filter (where status = 'critical') as critical
from log_records group by deployment_id""")

_add("a1_state_files", "select 'd' || deployment_id as id, state_key, state_value from memory")

_ARRIVED = """
with first as (select cast(min(ts) as date) as d0 from log_records),
sliced as (select l.*, (cast(ts as date) - d0) // 8 as slice, time_bucket(interval 1 day, ts) as w from log_records l, first),
arrived as (select *, case when seq % 50 = 7 then least(3, slice + 1) else slice end as batch from sliced),
marks as (
  select batch, max(max(ts)) over (order by batch rows between unbounded preceding and 1 preceding) - interval 2 day as mark
  from arrived group by batch),
told as (select a.*, coalesce(w + interval 1 day <= mark, false) as late from arrived a join marks using (batch))"""
_add("e5_window_counts_stream", _ARRIVED + """
select deployment_id, strftime(w, '%Y-%m-%d %H:%M:%S.%f') as window_start,
       count(*) filter (where status = 'info') as info, count(*) filter (where status = 'success') as success,
       count(*) filter (where status = 'warning') as warning, count(*) filter (where status = 'danger') as danger,
       count(*) filter (where status = 'critical') as critical
from told where not late and w + interval 1 day <= (select max(ts) - interval 2 day from log_records) group by deployment_id, w""")
_add("e5_late_window_counts", _ARRIVED + """
select deployment_id, strftime(w, '%Y-%m-%d %H:%M:%S.%f') as window_start, count(*) as late from told where late group by deployment_id, w""")

_add("a1_state_records", """
select deployment_id,
       max(state_value) filter (where state_key = 'vpc_id') as vpc_id,
       max(state_value) filter (where state_key = 'main_instance_id') as main_instance_id,
       cast(max(json_array_length(case when state_key = 'worker_instances_ids' then state_value end)) as int) as n_workers,
       max(json_extract_string(case when state_key = 'cws1_instances_ids' then state_value end, '$[0]')) as first_cws1
from state_entries group by deployment_id""")

_add("d2_instances_or_errors", """
select deployment_id, step, pos, case when step = 4 and deployment_id % 97 = 0 then left(instance_id, length(instance_id) - 1) else instance_id end
         as instance_id, null::varchar as error
from term_ids where step = 4 or deployment_id % 97 <> 0
union all
select deployment_id, case state_key when 'worker_instances_ids' then 1 when 'cws1_instances_ids' then 2 else 3 end, null, null, 'malformed list'
from state_entries where state_key in ('worker_instances_ids', 'cws1_instances_ids', 'cws2_instances_ids') and deployment_id % 97 = 0""")

_add("d2_malformed_lists", """
select deployment_id, state_key from (
  select deployment_id, state_key,
         case when deployment_id % 97 = 0 then left(state_value, length(state_value) - 1) else state_value end as v
  from state_entries where state_key in ('worker_instances_ids', 'cws1_instances_ids', 'cws2_instances_ids'))
where not json_valid(v)""")

_add("d7_select_by_instance_id", """
select t.deployment_id, t.step, t.pos, t.instance_id from term_ids t
where t.instance_id in (select instance_id from term_ids where pos = 0)""")

_add("a1_latest_snapshot", """
select deployment_id, state_key, state_value from state_entries where deployment_id % 2 = 1
union all
select deployment_id, state_key, state_value from residual where deployment_id % 2 = 0""")

_add("a2_deployed_state", """
with seen as (
  select i.deployment_id, i.launch_pos, coalesce('"' || o.public_ip || '"', 'null') as public_ip,
         coalesce('"' || o.private_ip || '"', 'null') as private_ip
  from inst6 i left join observed_addresses o on o.deployment_id = i.deployment_id and o.launch_pos = i.launch_pos),
lists as (
  select deployment_id, string_agg('{"public":' || public_ip || ',"private":' || private_ip || '}', ',' order by launch_pos) as l
  from seen group by deployment_id)
select deployment_id, 'main_instance_ip' as state_key, '10.0.1.5' as state_value from acc
union all
select a.deployment_id, t.state_key,
       coalesce((select '[' || string_agg('"' || i.private_ip || '"', ',' order by i.idx) || ']'
                 from inst i where i.deployment_id = a.deployment_id and i.tier = t.tier), '[]')
from acc a cross join (values ('workers_instance_ips', 'workers'), ('cws1_instance_ips', 'cws1'),
                              ('cws2_instance_ips', 'cws2')) t(state_key, tier)
union all
select a.deployment_id, 'instances_ips', '[' || coalesce(l.l, '') || ']' from acc a left join lists l using (deployment_id)""")

_DIGEST = """
select deployment_id, count(*) as n, cast(sum(cast('0x' || left(md5({line}), 15) as bigint)) as varchar) as digest
from {rows} group by deployment_id"""
_add("b12_endpoints_digest", _DIGEST.format(rows="endpoints", line="concat_ws('|', coalesce(section::varchar, '~'), coalesce(service::varchar, '~'), coalesce(pos::varchar, '~'), coalesce(ip::varchar, '~'), coalesce(port::varchar, '~'))"))

_add("b13_document_digest", _DIGEST.format(rows="endpoints", line="concat_ws('|', coalesce(section::varchar, '~'), coalesce(service::varchar, '~'), coalesce(pos::varchar, '~'), coalesce(ip::varchar, '~'), coalesce(port::varchar, '~'))"))

_add("c9_entries_digest", _DIGEST.format(rows="entries", line="concat_ws('|', coalesce(key::varchar, '~'), coalesce(value::varchar, '~'), coalesce(error::varchar, '~'))"))

_add("a1_read_state", "select deployment_id, state_key, state_value from state_entries")

_add("a2_state_to_json", """
with k(key, ord, is_list) as (select * from (values
  ('main_instance_ip', 0, false), ('workers_instance_ips', 1, true), ('cws1_instance_ips', 2, true),
  ('cws2_instance_ips', 3, true), ('vpc_id', 4, false), ('gateway_id', 5, false), ('main_subnet_id', 6, false),
  ('main_route_table_id', 7, false), ('main_route_table_association_id', 8, false),
  ('cws1_subnet_id', 9, false), ('cws1_route_table_id', 10, false),
  ('cws1_route_table_association_id', 11, false), ('cws2_subnet_id', 12, false),
  ('cws2_route_table_id', 13, false), ('cws2_route_table_association_id', 14, false),
  ('security_group_id', 15, false), ('keypair_name', 16, false), ('main_instance_id', 17, false),
  ('worker_instances_ids', 18, true), ('cws1_instances_ids', 19, true), ('cws2_instances_ids', 20, true),
  ('instances_ips', 21, true), ('lb_security_group_id', 22, false), ('load_balancer_arn', 23, false),
  ('load_balancer_dnsname', 24, false), ('target_group_arn', 25, false), ('listener_arn', 26, false)))
select e.deployment_id,
       '{"deployment_id":' || e.deployment_id || ',"state":{'
       || string_agg(to_json(e.state_key)::varchar || ':'
                     || case when coalesce(k.is_list, false) and starts_with(e.state_value, '[')
                             then e.state_value else coalesce(to_json(e.state_value)::varchar, 'null') end,
                     ',' order by coalesce(k.ord, 27), e.state_key)
       || '}}' as json
from state_entries e left join k on k.key = e.state_key
group by e.deployment_id""")

_add("a2_state_after_teardown_all", """
with k(key, ord, is_list) as (select * from (values
  ('main_instance_ip', 0, false), ('workers_instance_ips', 1, true), ('cws1_instance_ips', 2, true),
  ('cws2_instance_ips', 3, true), ('vpc_id', 4, false), ('gateway_id', 5, false), ('main_subnet_id', 6, false),
  ('main_route_table_id', 7, false), ('main_route_table_association_id', 8, false),
  ('cws1_subnet_id', 9, false), ('cws1_route_table_id', 10, false),
  ('cws1_route_table_association_id', 11, false), ('cws2_subnet_id', 12, false),
  ('cws2_route_table_id', 13, false), ('cws2_route_table_association_id', 14, false),
  ('security_group_id', 15, false), ('keypair_name', 16, false), ('main_instance_id', 17, false),
  ('worker_instances_ids', 18, true), ('cws1_instances_ids', 19, true), ('cws2_instances_ids', 20, true),
  ('instances_ips', 21, true), ('lb_security_group_id', 22, false), ('load_balancer_arn', 23, false),
  ('load_balancer_dnsname', 24, false), ('target_group_arn', 25, false), ('listener_arn', 26, false))),
ids as (select distinct deployment_id from state_entries)
select ids.deployment_id,
       '{"deployment_id":' || ids.deployment_id || ',"state":{'
       || coalesce(string_agg(to_json(e.state_key)::varchar || ':'
                              || case when coalesce(k.is_list, false) and starts_with(e.state_value, '[')
                                      then e.state_value else coalesce(to_json(e.state_value)::varchar, 'null') end,
                              ',' order by coalesce(k.ord, 27), e.state_key) filter (where e.state_key is not null), '')
       || '}}' as json
from ids left join residual e on e.deployment_id = ids.deployment_id left join k on k.key = e.state_key
group by ids.deployment_id""")

VARIANTS["a2_state_after_teardown_bucketed"] = ("a2_state_after_teardown_all", {})
VARIANTS["a2_state_after_abort"] = ("a2_state_after_teardown_all", _ABORTED)
VARIANTS["a2_state_emptied"] = ("a2_state_after_teardown_all", {
    "teardown_outcomes": FIXTURE_CTES["teardown_outcomes"].replace("(o_custkey + step) % 4 <> 0 as ok", "true as ok")})

# Folded change logs: what the runs left, key by key.
_add("a1_fold_changes", """
select deployment_id, state_key, state_value from memory
union all
select r.deployment_id, r.state_key, r.state_value from residual r
where not exists (select 1 from memory m where m.deployment_id = r.deployment_id and m.state_key = r.state_key)""")

VARIANTS["a1_compacted_store"] = ("a1_fold_changes", {})

_add("a1_fold_changes_upto", "select deployment_id, state_key, state_value from residual")

_KEYS = ORACLES["a2_state_to_json"].partition("select e.deployment_id")[0]

_add("a1_latest_changes", _KEYS + """
select m.deployment_id, cast(3000 + k.ord as bigint) as change_no, m.state_key, 'set' as op, m.state_value
from memory m join k on k.key = m.state_key
union all
select r.deployment_id, 1000 + k.ord, r.state_key, 'set', r.state_value from residual r join k on k.key = r.state_key
where not exists (select 1 from memory m where m.deployment_id = r.deployment_id and m.state_key = r.state_key)
union all
select r.deployment_id, 2000 + 10 * s.step + s.rpos, r.key, 'remove', null from removed r join removes s on s.key = r.key
where not exists (select 1 from memory m where m.deployment_id = r.deployment_id and m.state_key = r.key)""")

_add("a2_repeated_keys", ORACLES["a2_state_to_json"].replace("select e.deployment_id", """, last as (
  select deployment_id, state_key, state_value from memory
  union all
  select e.deployment_id, e.state_key, e.state_value from state_entries e
  where not exists (select 1 from memory m where m.deployment_id = e.deployment_id and m.state_key = e.state_key))
select e.deployment_id""").replace("from state_entries e left join k", "from last e left join k"))

_add("a3_config_failures", """
select deployment_id, min(error) as error from entries group by deployment_id having count(error) > 0""")

_add("a3_config_failures_nested", """
select deployment_id,
       case when bool_or(error = 'missing required key') then 'missing required key' else min(error) end as error
from entries group by deployment_id having count(error) > 0""")

_add("a3_write_config", """
with ok as (select deployment_id from entries group by deployment_id having count(error) = 0),
rk as (select deployment_id, 'bind_address' as key, '""' as value from parts
       union all select deployment_id, 'http_port', rankings_port from parts
       union all select deployment_id, 'username', rankings_user from parts
       union all select deployment_id, 'password',
                        case when rankings_passwd is not null then '"********"' end from parts),
both_docs as (select deployment_id, 'cms.conf' as doc, key, value from entries
              union all select deployment_id, 'cms.ranking.conf', key, value from rk)
select deployment_id, doc, key,
       case when value is null or value = 'null' then null
            when starts_with(value, '"') then json_extract_string(value, '$') else value end as value
from both_docs where deployment_id in (select deployment_id from ok)""")

_add("a3_config_files", ORACLES["a3_write_config"].replace("select deployment_id, doc, key,", "select 'd' || deployment_id as id, doc, key,")
     .replace("'cms.conf' as doc", "'config' as doc").replace("'cms.ranking.conf'", "'ranking'"))
VARIANTS["a3_config_files"] = ("a3_config_files", _NESTED)

_add("a4_read_requests", """
select deployment_id, id, title, nb_workers_instances, nb_workers_per_instance, nb_cws_instances,
       nb_cws_per_instance, config_phase, main_instance_type, workers_instances_type, cws_instances_type,
       cms_contest, strftime(requested_at, '%Y-%m-%d %H:%M:%S.%f') as requested_at
from deployment_requests""")
