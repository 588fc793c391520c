"""DuckDB oracle SQL for the folding queries."""

from __future__ import annotations

CHANGED = """e as (select event_id, ts, user_id, event_type, props,
        lag(event_type) over (partition by user_id order by ts, event_id) as prev_speaker
      from events),
    c as (select *, prev_speaker is distinct from event_type as changed from e)"""

LAST_OUTPUT = f"""{CHANGED},
    lo as (select user_id,
             arg_max(props, (ts, event_id)) filter (where not changed and coalesce(props, '') <> '') as last_output
           from c group by user_id)"""

SQL = {
    "state_last_write": """select user_id, event_type, arg_max(value, (ts, event_id)) as last_value
        from events group by user_id, event_type""",
    "speaker_change": f"with {CHANGED} select event_id, user_id, prev_speaker, changed from c",
    "last_output": f"with {LAST_OUTPUT} select * from lo",
    "run_summary": f"""with {LAST_OUTPUT},
        st as (select user_id,
                 coalesce(arg_max(printf('%.2f', value), (ts, event_id)) filter (where event_type = 'purchase'),
                          'Not written yet.') as report,
                 coalesce(arg_max(printf('%.2f', value), (ts, event_id)) filter (where event_type = 'signup'),
                          'Review required.') as review
               from events group by user_id)
        select coalesce(st.user_id, lo.user_id) as user_id, coalesce(lo.last_output, '') as response,
               st.report, st.review
        from st full join lo on st.user_id = lo.user_id""",
    "call_budget": """with b as (select event_id, user_id,
            coalesce(sum(case when event_type <> 'error' then 1 else 0 end) over (
              partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0)::bigint
              as n_prior_ok
          from events)
        select event_id, user_id, n_prior_ok, n_prior_ok >= 10 as rejected from b""",
    "next_sibling": """select u.conv_id, u.turn,
          coalesce((select min(a.turn) from conversations a
            where a.conv_id = u.conv_id and a.role = 'assistant' and a.turn > u.turn), -1) as next_turn
        from conversations u where u.role = 'user'""",
    "section_cross": """with s as (select conv_id, arg_min(role || ':' || turn::varchar, turn) as section
                         from conversations where turn < 2 group by conv_id)
        select c.conv_id, c.turn, s.section from conversations c join s on c.conv_id = s.conv_id""",
}
