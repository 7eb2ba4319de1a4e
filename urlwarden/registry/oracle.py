"""The registered queries as DuckDB SQL over the same tables, written apart from the Spark jobs."""

from __future__ import annotations

from urlwarden import fixed_values as V
from urlwarden.functions.lexical import PROFILES
from urlwarden.registry.corpora import BRACKET_FORMS, HOST_TLDS, IP_PREFIXES, PAYLOAD_FEATURES, TEMPLATES


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def qlist(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


WS = q(V.WHITESPACE)
DIGIT = V.DIGIT


def count(text: str, pattern: str) -> str:
    return f"(length({text}) - length(regexp_replace({text}, '{pattern}', '', 'g')))"


def share(n: str, total: str) -> str:
    return f"(case when {total} > 0 then {n}::double / {total} else 0.0 end)"


def entropy(text: str) -> str:
    return f"coalesce(list_aggregate(string_split({text}, ''), 'entropy'), 0.0)"


def when_any(conditions) -> str:
    return "(" + " or ".join(conditions) + ")"


def bracket_forms(piece: str, pos: str) -> str:
    """The request a piece of text makes at its position."""
    word = f"string_split(trim({piece}, ' '), ' ')[1]"
    cases = " ".join(f"when {i} then {q(head)} || {word} || {q(tail)}" for i, (head, tail) in enumerate(BRACKET_FORMS, start=1))
    return f"case {pos} % {len(BRACKET_FORMS) + 1} {cases} else {piece} end"


# ---- corpora ----------------------------------------------------------------

N = len(TEMPLATES)
SCANS = f"""
scans as (
  select event_id as scan_id, ts, value as latency, event_type, user_id, event_id % {N} as template,
    case when event_id % {N} < {len(V.BENIGN_URLS)} then 0 else 1 end as is_phishing,
    {qlist(TEMPLATES)}[event_id % {N} + 1] as base,
    case (event_id // {N}) % 4
      when 0 then base when 1 then upper(base) when 2 then '  ' || base || '  '
      else base || '/p' || user_id end as url
  from events)"""
DOC_URLS = f"""
doc_lines as (
  select doc_id, unnest(string_split(text, chr(10))) as line,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no
  from documents),
doc_urls as (
  select doc_id * 1000000 + line_no as url_id,
    split_part(line, ' ', 1) as w1, split_part(line, ' ', 2) as w2,
    'http://' || rtrim(w1 || '-' || w2, '-') || {qlist(HOST_TLDS)}[(doc_id + line_no) % {len(HOST_TLDS)} + 1]
      || '/' || replace(substr(line, length(w1) + length(w2) + 3), ' ', '-') as url
  from doc_lines)"""
ALL_URLS = f"""{SCANS}, {DOC_URLS},
all_urls as (
  select 'scan' as corpus, scan_id as url_id, url from scans
  union all select 'page', page_id, url from pages
  union all select 'doc', url_id, url from doc_urls)"""


def parts(src: str, out: str) -> str:
    """CTEs adding the URL parts to a table with a url column."""
    schemes = ", ".join(q(s) for s in V.PARAM_SCHEMES)
    return f"""
{out}_a as (
  select *, lower(trim(url, {WS})) as canonical,
    replace(replace(replace(case when contains(canonical, '://') then canonical
      else 'http://' || canonical end, chr(9), ''), chr(13), ''), chr(10), '') as full_url,
    regexp_extract(full_url, '^([a-z][a-z0-9+.\\-]*):', 1) as scheme,
    case when scheme = '' then full_url else substr(full_url, length(scheme) + 2) end as rest
  from {src}),
{out}_b as (
  select *, regexp_extract(rest, '^//([^/?#]*)', 1) as netloc,
    regexp_extract(rest, '^[^?#]*\\?([^#]*)', 1) as query,
    regexp_extract(case when starts_with(rest, '//') then regexp_replace(rest, '^//[^/?#]*', '')
      else rest end, '^([^?#]*)', 1) as raw_path,
    case when scheme in ({schemes}) then regexp_replace(raw_path, ';[^/]*$', '') else raw_path end as path
  from {out}_a),
{out} as (
  select *, case when netloc <> '' then netloc else split_part(path, '/', 1) end as host,
    regexp_replace(split_part(netloc, ':', 1), '^www\\.', '') as domain,
    regexp_replace(split_part(regexp_replace(netloc, '^.*@', ''), ':', 1), '^www\\.', '') as strict_domain,
    string_split(domain, '.') as labels,
    {apex('labels', 'domain')} as apex
  from {out}_b)"""


def apex(labels: str, domain: str) -> str:
    second = ", ".join(q(s) for s in V.SECOND_LEVEL_LABELS)
    return f"""case when len({labels}) < 3 then {domain}
      when {labels}[-2] in ({second}) and length({labels}[-1]) = 2
        then array_to_string({labels}[-3:], '.')
      else array_to_string({labels}[-2:], '.') end"""


def distances(label: str, brands: list[str]) -> str:
    # Bytes are compared here, so characters beyond ASCII become one byte no brand contains.
    plain = f"regexp_replace({label}, '[^\\x00-\\x7F]', '~', 'g')"
    return f"list_transform({qlist(brands)}, lambda b: levenshtein({plain}, b))"


LEXICON = "[" + ", ".join(f"{{'c': {q(c)}, 'k': {q(k)}}}"
                          for c, ks in V.LEXICON_V4.items() for k in ks) + "]"


def features_v4(src: str, out: str) -> str:
    """CTEs adding the v4 features, risk and verdict to a table with URL parts."""
    w = V.RISK_WEIGHTS
    plain = ", ".join(q(s) for s in V.PLAIN_LABELS)
    tlds = when_any(f"ends_with(host, {q(t)})" for t in V.TLDS_V4)
    return f"""
{out}_a as (
  select *, length(canonical) as url_length, length(host) as domain_length,
    split_part(host, '.', 1) as label,
    {share(count('canonical', DIGIT), 'url_length')} as digit_ratio,
    {share(count('canonical', '[^\\p{L}\\p{N}:/.\\-]'), 'url_length')} as special_ratio,
    greatest(0, len(list_filter(string_split(host, '.'), lambda s: s <> '' and s not in ({plain}))) - 1) as num_subdomains,
    (case when regexp_matches(host, '{V.IPV4_PREFIX_PATTERN}') then 1 else 0 end) as has_ip,
    {entropy('host')} as entropy, {entropy('canonical')} as url_entropy,
    {distances('label', V.BRANDS_V4)} as dists,
    list_min(dists) as brand_dist,
    case when brand_dist <= 3 then {qlist(V.BRANDS_V4)}[list_position(dists, brand_dist)] else 'None' end as matched_brand,
    (case when {tlds} then 1 else 0 end) as has_suspicious_tld,
    list_filter({LEXICON}, lambda m: contains(canonical, m.k)) as lures,
    (case when len(lures) > 0 then 1 else 0 end) as has_sensitive_keywords,
    (case when contains(canonical, 'xn--') or regexp_matches(canonical, '[^\\x00-\\x7F]') then 1 else 0 end) as is_punycode,
    case when length(label) < 5 then 0.0::double else round(least(1.0::double,
      (case when entropy > 4.2 then 0.35 else 0.0 end)::double
      + (case when {count('label', V.VOWEL)}::double / length(label) < 0.2::double then 0.25 else 0.0 end)::double
      + (case when regexp_matches(label, '{V.CONSONANT}{{4,}}') then 0.25 else 0.0 end)::double
      + (case when {count('label', '\\p{Nd}')} > 3 then 0.15 else 0.0 end)::double), 2) end as dga_score
  from {src}),
{out} as (
  select *, brand_dist between 1 and 2 as typosquat, dga_score >= 0.5::double as dga,
    round(least({w['cap']}::double, greatest({w['floor']}::double, {w['base']}::double
      + (case when typosquat then {w['typosquat']} else 0 end)::double
      + (case when dga then {w['dga']} else 0 end)::double
      + (case when has_sensitive_keywords = 1 then {w['lure']} else 0 end)::double
      + (case when has_suspicious_tld = 1 then {w['tld']} else 0 end)::double
      + (case when has_ip = 1 then {w['ip']} else 0 end)::double
      + (case when entropy > 4.2 then {w['entropy']} else 0 end)::double)), 4) as risk_score,
    {verdict('risk_score', V.THRESHOLDS_V4)} as verdict
  from {out}_a)"""


def verdict(risk: str, t: dict) -> str:
    return (f"case when {risk} >= {t['MALICIOUS']} then 'MALICIOUS' "
            f"when {risk} >= {t['SUSPICIOUS']} then 'SUSPICIOUS' else 'SAFE' end")


ALL_PARTS = ALL_URLS + "," + parts("all_urls", "p")
ALL_V4 = ALL_PARTS + "," + features_v4("p", "f")
SCAN_V4 = SCANS + "," + parts("scans", "sp") + "," + features_v4("sp", "sf")


def with_(ctes: str, body: str) -> str:
    return f"with recursive {ctes.strip()}\n{body}"


def vector(profile: str) -> str:
    return ", ".join(f"round({c}::double, 6) as f{i + 1}" for i, c in enumerate(PROFILES[profile].vector))


def features_old(profile: str, host: str) -> str:
    p = PROFILES[profile]
    ends = "canonical" if profile == "train" else "h"
    tlds = [f"ends_with({ends}, {q(t)})" for t in p.tlds]
    if profile == "train":
        tlds += [f"contains(canonical, {q(t + '/')})" for t in p.tlds]
        ip = f"regexp_matches(h, '{DIGIT}') and {count('h', '[.]')} = 3"
        subs = count("canonical", "[.]")
    else:
        ip = f"regexp_matches(h, '{V.IPV4_WHOLE_PATTERN}')"
        subs = count("h", "[.]")
    kw = " + ".join(f"(case when contains(canonical, {q(k)}) then 1 else 0 end)" for k in p.keywords)
    return f"""
o as (
  select *, {host} as h, length(canonical) as url_length, length(h) as domain_length,
    length(path) as path_length, split_part(h, '.', 1) as label,
    {share(count('canonical', DIGIT), 'url_length')} as digit_ratio,
    {share(count('canonical', '[^\\p{L}\\p{N}]'), 'url_length')} as special_ratio,
    greatest(0, {subs} - 1) as num_subdomains,
    (case when {ip} then 1 else 0 end) as has_ip,
    (case when contains(h, 'xn--') then 1 else 0 end) as has_punycode,
    {entropy('canonical')} as url_entropy, {entropy('h')} as entropy,
    case when h = '' then 999 else list_min({distances('label', p.brands)}) end as brand_dist,
    (case when {when_any(tlds)} then 1 else 0 end) as has_suspicious_tld,
    {kw} as keyword_count,
    (case when contains(canonical, '@') then 1 else 0 end) as has_at_symbol,
    (case when scheme = 'https' then 1 else 0 end) as is_https,
    (case when contains(path, '//') then 1 else 0 end) as has_double_slash,
    (case when query = '' then 0 else len(string_split(query, '&')) end) as query_param_count
  from p)"""


# ---- allow-list -------------------------------------------------------------

def allowed(domain: str, apex_: str) -> str:
    inlist = ", ".join(q(d) for d in V.ALLOW_DOMAINS_V4)
    return f"""(not {guarded(domain)} and ({domain} in ({inlist}) or {apex_} in ({inlist}) or {trusted(domain)}))"""


def guarded(domain: str) -> str:
    return f"(contains({domain}, 'xn--') or regexp_matches({domain}, '[^\\x00-\\x7F]'))"


def trusted(domain: str) -> str:
    return when_any(f"regexp_matches({domain}, '{p}')" for p in V.ALLOW_PATTERNS)


BASE_ALLOW = "base_allow(domain) as (values " + ", ".join(f"({q(d)})" for d in V.ALLOW_DOMAINS_V4) + ")"
CUSTOM_ALLOW = "custom_allow as (select distinct lower(regexp_extract(url, '//([^/?#]*)', 1)) as domain from pages)"

# ---- verdict cache ----------------------------------------------------------

TTL = ("(case {v} when 'MALICIOUS' then %d when 'SUSPICIOUS' then %d else %d end)" % (
    V.TTL_SECONDS["MALICIOUS"], V.TTL_SECONDS["SUSPICIOUS"], V.TTL_SECONDS["SAFE"]))
SCORED = SCAN_V4 + f""",
scored as (
  select *, sha256(canonical) as url_hash, {TTL.format(v='verdict')} as ttl,
    {allowed('domain', 'apex')} as is_allowed
  from sf),
history as (
  select url_hash, url, verdict, risk_score, ts + interval 1 second as cached_at,
    cached_at + ttl * interval 1 second as expires_at
  from scored where event_type = 'signup' and not is_allowed),
history_one as (
  select url_hash, cached_at, max(expires_at) as expires_at, arg_max(verdict, (expires_at, url)) as verdict,
    arg_max(risk_score, (expires_at, url)) as risk_score
  from history group by url_hash, cached_at),
looked as (
  select s.*, case when s.ts <= h.expires_at then h.verdict end as cached_verdict,
    case when s.ts <= h.expires_at then h.risk_score end as cached_risk,
    case when s.ts <= h.expires_at then 1 else 0 end as hit
  from scored s asof left join history_one h on s.url_hash = h.url_hash and s.ts >= h.cached_at)"""
UPSERTED = SCORED + """,
entries as (
  select url_hash, url, verdict, risk_score, cached_at, expires_at from history
  union all
  select url_hash, url, verdict, risk_score, ts, ts + ttl * interval 1 second
  from scored where event_type = 'purchase' and not is_allowed),
upserted as (
  select url_hash, verdict, risk_score, cached_at, expires_at from entries
  qualify row_number() over (partition by url_hash order by cached_at desc, expires_at desc, url desc) = 1)"""

REPLAY = SCORED + """,
chain as (
  select url_hash, ttl, min(ts) as at from scored where not is_allowed group by url_hash, ttl
  union all
  select c.url_hash, c.ttl, (select min(s.ts) from scored s
    where s.url_hash = c.url_hash and s.ts > c.at + c.ttl * interval 1 second) as at
  from chain c where c.at is not null),
misses as (
  select s.url_hash, c.at, min(s.scan_id) as scan_id
  from chain c join scored s on s.url_hash = c.url_hash and s.ts = c.at
  group by s.url_hash, c.at),
replayed as (
  select s.*, case when m.scan_id is null and not is_allowed then 1 else 0 end as rhit
  from scored s left join misses m on s.scan_id = m.scan_id)"""

# ---- forensics --------------------------------------------------------------

TECH = {k: f"{{'id': {q(t[0])}, 'name': {q(t[1])}}}" for k, t in V.TECHNIQUES.items()}
IND = V.INDICATORS


def pct(x: str, digits: int) -> str:
    return f"printf('%.{digits}f', {x} * 100)"


LURE_TEXT = "array_to_string(list_transform(lures[1:3], lambda m: '''' || m.k || ''' (' || m.c || ')'), ', ')"


def text(template: str, *args: str) -> str:
    """A printf call; arguments fill the placeholders of the fixed text."""
    return f"printf({q(template)}, {', '.join(args)})"


TECHNIQUES = f"""(case when not (typosquat or is_punycode = 1 or dga or has_sensitive_keywords = 1 or has_ip = 1)
    and verdict <> 'SAFE' then [{TECH['fallback']}]
  else list_filter([case when typosquat then {TECH['typosquat']} end,
    case when is_punycode = 1 then {TECH['homograph']} end,
    case when dga then {TECH['dga']} end,
    case when has_sensitive_keywords = 1 then {TECH['lure']} end,
    case when has_ip = 1 then {TECH['ip']} end], lambda t: t is not null) end)"""
FOUND = {
    "typosquat": f"case when typosquat then {text(IND['typosquat'], 'upper(matched_brand)', 'brand_dist')} end",
    "homograph": f"case when is_punycode = 1 then {q(IND['homograph'])} end",
    "dga": f"case when dga then {text(IND['dga'], 'dga_score * 100', 'entropy')} end",
    "lure": f"case when has_sensitive_keywords = 1 then {text(IND['lure'], LURE_TEXT)} end",
    "ip": f"case when has_ip = 1 then {q(IND['ip'])} end",
    "tld": f"case when has_suspicious_tld = 1 then {q(IND['tld'])} end",
    "subdomains": f"case when num_subdomains >= 2 then {text(IND['subdomains'], 'num_subdomains')} end",
}
INDICATORS = (f"list_filter([{', '.join(FOUND.values())}, case when verdict = 'SAFE' then {q(IND['safe'])} end], "
              "lambda t: t is not null)")
ANOMALIES = ("(typosquat::int + is_punycode + dga::int + has_sensitive_keywords + has_ip + has_suspicious_tld "
             "+ (num_subdomains >= 2)::int)")
ACTIONS = f"""list_concat(case when typosquat then {qlist(V.ACTIONS['typosquat'])} else []::varchar[] end,
  case verdict when 'MALICIOUS' then {qlist(V.ACTIONS['MALICIOUS'])}
    when 'SUSPICIOUS' then {qlist(V.ACTIONS['SUSPICIOUS'])} else {qlist(V.ACTIONS['SAFE'])} end)"""
SUMMARY = f"""case verdict when 'MALICIOUS' then {text(V.SUMMARIES['MALICIOUS'], 'risk_score * 100', ANOMALIES)}
  when 'SUSPICIOUS' then {text(V.SUMMARIES['SUSPICIOUS'], ANOMALIES)} else {q(V.SUMMARIES['SAFE'])} end"""


def pair(key: str, contribution: str | None = None) -> str:
    name, fixed = V.CONTRIBUTIONS[key]
    return f"{{'f': {q(name)}, 'c': {contribution or q(fixed)}}}"


XAI_FOUND = f"""list_filter([case when typosquat then {pair('typosquat')} end,
  case when dga then {pair('dga', "printf('+%.1f%%', dga_score * 30)")} end,
  case when has_sensitive_keywords = 1 then {pair('lure')} end,
  case when has_suspicious_tld = 1 then {pair('tld')} end,
  case when has_ip = 1 then {pair('ip')} end,
  case when entropy > 4.2 then {pair('entropy')} end], lambda t: t is not null)"""
XAI = f"(case when len({XAI_FOUND}) = 0 then [{pair('none')}] else {XAI_FOUND} end)"


def exploded(expr: str) -> str:
    return (f"x as (select corpus, url_id, {expr} as items from f), "
            "y as (select corpus, url_id, unnest(items) as t, generate_subscripts(items, 1) - 1 as pos from x)")


# ---- cascade and telemetry --------------------------------------------------

STRIPPED = f"trim(url, {WS})"
DOTS = f"printf('%d Levels', greatest(0, len(string_split({STRIPPED}, '.')) - 2))"


def cascade(src: str, hit: str, out: str, cached_verdict: str, cached_risk: str) -> str:
    return f"""{out} as (
  select scan_id, ts, {STRIPPED} as url, latency, template,
    case when is_allowed then 'SAFE' when {hit} then {cached_verdict} else verdict end as verdict,
    case when is_allowed then {q(V.SOURCE_ALLOW)} when {hit} then {q(V.SOURCE_CACHE)}
      else {q(V.SOURCE_SCORER)} end as source,
    case when is_allowed then 0.0 when {hit} then {cached_risk} else risk_score end as risk_score,
    case when is_allowed then {q(V.SUMMARIES['allowed'])}
      when {hit} then {text(V.SUMMARIES['cached'], f'{cached_risk} * 100')} else {SUMMARY} end as summary,
    case when is_allowed or {hit} then {DOTS} else printf('%d Levels', num_subdomains) end as subdomains,
    case when is_allowed then {q(IND['allowed'])} when {hit} then {q(IND['cached'])}
      else array_to_string({INDICATORS}, ' | ') end as indicators,
    case when is_allowed then {q(' | '.join(V.ACTIONS['allowed']))}
      when {hit} then {q(' | '.join(V.ACTIONS['cached']))}
      else array_to_string({ACTIONS}, ' | ') end as actions
  from {src})"""


CASCADE = SCORED + "," + cascade("looked", "hit = 1", "results", "cached_verdict", "cached_risk")
HOST = "split_part(split_part(list_last(string_split({u}, '://')), '/', 1), ':', 1)"
DNS = f"""dns as (
  select lower({HOST.format(u="trim(url, ' ')")}) as host,
    min({qlist(IP_PREFIXES)}[template % 4 + 1] || '0.0.' || template) as ip
  from scans where template % 7 <> 0 group by 1)"""
NET = V.NETWORK_TEXTS["api"]
NETWORK = f"""coalesce(d.ip, {q(NET['no_ip'])}) as resolved_ip,
    case when d.ip is null then {q(NET['no_asn'])}
      when starts_with(d.ip, '104.') or starts_with(d.ip, '172.') then {q(V.ASN_BY_PREFIX[0][1])}
      when starts_with(d.ip, '185.') or starts_with(d.ip, '192.') then {q(V.ASN_BY_PREFIX[1][1])}
      else printf({q(NET['resolved'])}, d.ip) end as asn_owner"""
RANGES = f"""nets as (
  select {[int(p[:-1]) for p in IP_PREFIXES]}[n_nationkey % 4 + 1] * 16777216::bigint + n_nationkey * 3 as lo, lo + 60 - n_nationkey as hi,
    n_name as owner from nation
  union all select {[int(p[:-1]) for p in IP_PREFIXES]}[s_suppkey % 4 + 1] * 16777216::bigint + s_suppkey * 7 % 90 as lo, lo + s_suppkey % 11 as hi,
    s_name from supplier),
ips as (
  select distinct ip, split_part(ip, '.', 1)::bigint * 16777216 + split_part(ip, '.', 2)::bigint * 65536
    + split_part(ip, '.', 3)::bigint * 256 + split_part(ip, '.', 4)::bigint as ip_number from dns),
owned as (
  select ip, ip_number, (select owner from nets where ip_number between lo and hi order by hi - lo, lo, owner limit 1) as owner from ips)"""
SUFFIXES = """suffixes as (
  select distinct trim(regexp_replace(lower(regexp_extract(url, '//([^/?#:]*)', 1)), '^[^.]*\\.', ''), ' .') as suffix from pages),
ended as (
  select h.domain, max_by(s.suffix, length(s.suffix)) as suffix from (select distinct domain from p) h
  join suffixes s on s.suffix <> '' and (lower(h.domain) = s.suffix or ends_with(lower(h.domain), '.' || s.suffix)) group by 1)"""
LOG = REPLAY + "," + cascade("replayed", "rhit = 1", "results", "verdict", "risk_score") + f""", {DNS},
log as (
  select r.scan_id as id, r.url, r.verdict, r.source, r.risk_score, r.latency, r.ts as timestamp,
    {NETWORK}, r.summary, r.indicators
  from results r left join dns d on d.host = lower({HOST.format(u='r.url')}))"""
LOG_COLUMNS = "id, url, verdict, source, risk_score, latency, timestamp, resolved_ip, asn_owner"
STATS = """count(*) as total_scans, count(*) filter (where verdict = 'MALICIOUS') as malicious_count,
  count(*) filter (where verdict = 'SAFE') as safe_count,
  count(*) filter (where verdict = 'SUSPICIOUS') as suspicious_count,
  round(coalesce(avg(latency), 0), 3) as avg_latency_ms,
  count(*) filter (where contains(source, 'Tier-3')) as tier3_whitelist,
  count(*) filter (where contains(source, 'Tier-1')) as tier1_redis_cache,
  count(*) filter (where contains(source, 'Tier-2')) as tier2_nlp_ensemble"""

CATALOGUE = ("catalogue(technique_id, name, tactic) as (values "
             + ", ".join(f"({q(t[0])}, {q(t[1])}, {q(t[2])})" for t in V.TECHNIQUE_CATALOGUE) + ")")
CATALOGUE_TEXT = ("catalogue_text(technique_id, name, tactic, description) as (values "
                  + ", ".join(f"({q(t[0])}, {q(t[1])}, {q(t[2])}, {q(t[4])})" for t in V.TECHNIQUE_CATALOGUE) + ")")
ID = "corpus, url_id"
ONE_PAGE_ALLOW = f"{BASE_ALLOW}, {CUSTOM_ALLOW}, allow as (select domain from base_allow union select domain from custom_allow)"
V3_LIST = ", ".join(q(d) for d in V.ALLOW_DOMAINS_V3)


# ---- training and preparation -----------------------------------------------

CHAR_TEXT = "regexp_replace(lower(url), '\\s\\s+', ' ', 'g')"


def char_terms(src: str, key: str) -> str:
    return f"""cw as (select {key}, {CHAR_TEXT} as c from {src}),
grams as (
  select {key}, unnest(list_transform(range(1, length(c) - n + 2), lambda i: substr(c, i, n))) as term
  from cw, (values (3), (4), (5)) k(n) where length(c) >= n)"""


WORD_GRAMS = """tokens as (
  select corpus, url_id, regexp_extract_all(lower(url), '[\\p{L}\\p{M}\\p{N}_]{2,}') as t from all_urls),
wgrams as (
  select corpus, url_id, unnest(t) as term from tokens
  union all
  select corpus, url_id, unnest(list_transform(range(1, len(t) - n + 2), lambda i: array_to_string(t[i:i + n - 1], ' ')))
  from tokens, (values (2), (3)) k(n) where len(t) >= n)"""

PAYLOADS = f"""payloads as (
  select doc_id, n_chars, round({entropy('text')}, 5) as shannon_entropy, length(text) as char_length,
    round({share(count('text', DIGIT), 'length(text)')}, 5) as digit_ratio,
    round({share(count('text', '[^\\p{L}\\p{N}]'), 'length(text)')}, 5) as special_char_ratio,
    round({share(count('text', '\\p{Lu}'), 'length(text)')}, 5) as uppercase_ratio, toxic as target
  from documents join labels using (doc_id))"""
SPLITS = """ranked as (
  select doc_id, toxic as target, row_number() over (partition by toxic order by sha256('42|' || doc_id)) as rn,
    count(*) over (partition by toxic) as n
  from labels),
splits as (
  select *, case when rn <= round(n * 0.20::double) then 'test'
      when rn <= round(n * (0.20::double + 0.10::double)) then 'val' else 'train' end as split,
    (rn > round(n * 0.2::double))::int + (rn > round(n * 0.4::double))::int
      + (rn > round(n * 0.6::double))::int + (rn > round(n * 0.8::double))::int as fold
  from ranked)"""


def robust(c: str) -> str:
    iqr = f"(select quantile_cont({c}::double, 0.75) - quantile_cont({c}::double, 0.25) from fit)"
    return (f"round(({c} - (select median({c}::double) from fit)) / "
            f"(case when {iqr} = 0 then 1.0 else {iqr} end), 6) as {c}")


def standard(c: str) -> str:
    return f"round(({c} - avg({c}) over ()) / coalesce(nullif(stddev_pop({c}) over (), 0), 1), 6) as {c}"


YJ = ("(case when {x} >= 0 then (case when abs({l}) < 1e-9 then ln(1 + {x}) else (pow({x} + 1, {l}) - 1) / {l} end) "
      "else (case when abs({l} - 2) < 1e-9 then -ln(1 - {x}) else -(pow(1 - {x}, 2 - {l}) - 1) / (2 - {l}) end) end)")


def yj_search(grid: str, k: int) -> str:
    """CTEs up to ``best{k}``: the likeliest Yeo-Johnson exponent of events.value on a grid."""
    return f"""llf{k} as (select lam, -count(*) / 2.0::double * ln(var_pop({YJ.format(x='value', l='lam')})) + (lam - 1) * sum(sign(value) * ln(1 + abs(value))) as f
          from events, {grid} group by lam),
        best{k} as (select arg_max(lam, (f, -lam)) as lam from llf{k})"""


def extra_tree(features: list[str], depth: int, tried: int) -> str:
    """CTEs that grow one extra-tree over payloads level by level: ``nodes`` in the end."""
    def drawn(what: str) -> str:
        return f"(('0x' || substr(sha256('42|0|' || node || '|' || f || '|{what}'), 1, 8))::bigint / 4294967296.0::double)"

    def impurity(n: str, p: str) -> str:
        return f"(case when {n} > 0 then ({p})::double * (({n}) - ({p})) / ({n}) else 0 end)"

    values = " union all ".join(f"select doc_id, {i} as f, {c}::double as v from payloads" for i, c in enumerate(features))
    out = [f"vals as ({values})", "at0 as (select doc_id, target, 1::bigint as node from payloads)"]
    for k in range(depth):
        out.append(f"""size{k} as (select node, count(*) as n, sum(target)::bigint as pos from at{k} group by node),
        cuts{k} as (select node, f, lo + {drawn('cut')} * (hi - lo) as cut, n, pos,
            row_number() over (partition by node order by {drawn('order')}, f) as j
          from (select node, f, min(v) as lo, max(v) as hi from at{k} join vals using (doc_id) group by 1, 2) join size{k} using (node)
          where lo < hi and pos > 0 and pos < n),
        tried{k} as (select node, f, cut, n, pos, j, count(*) filter (where v <= cut) as w, coalesce(sum(target) filter (where v <= cut), 0) as p
          from cuts{k} join at{k} using (node) join vals using (doc_id, f) where j <= {tried} group by all),
        best{k} as (select node, f, cut from tried{k} qualify row_number() over (partition by node
          order by round({impurity('w', 'p')} + {impurity('n - w', 'pos - p')}, 9), j) = 1),
        at{k + 1} as (select doc_id, target, 2 * node + (v > cut)::bigint as node from at{k} join best{k} using (node) join vals using (doc_id, f))""")
    levels = [f"select node, coalesce(f, -1)::bigint as feature, coalesce(round(cut, 6), 0) as cut, n, pos from size{k} left join best{k} using (node)"
              for k in range(depth)]
    levels.append(f"select node, -1::bigint, 0::double, count(*), sum(target)::bigint from at{depth} group by node")
    return ",".join([*out, f"nodes as ({' union all '.join(levels)})"])


def oracle_sql() -> dict[str, str]:
    sql = {
        "src_labeled_urls": with_(SCANS, "select url, is_phishing as label from scans"),
        "src_template_corpus": with_(DOC_URLS, "select url, 0 as label from pages union all select url, 1 from doc_urls"),
        "src_custom_allowlist": with_(CUSTOM_ALLOW, "select domain from custom_allow"),
        "sink_telemetry": with_(LOG, "select id, url, verdict, strftime(timestamp, '%Y-%m-%d') as scan_date, summary from log"),
        "dataset_fingerprint": with_(ALL_URLS, """select count(*) as n_rows,
            sum(('0x' || substr(sha256(corpus || chr(31) || url_id || chr(31) || url), 1, 8))::bigint)::varchar as fingerprint
            from all_urls"""),
        "url_canonical": with_(ALL_PARTS, f"select {ID}, canonical from p"),
        "url_hash": with_(ALL_PARTS, f"select {ID}, 'verdict:' || sha256(canonical) as url_hash from p"),
        "url_parts": with_(ALL_PARTS, f"select {ID}, scheme, netloc, path, query, host from p"),
        "allow_domain": with_(ALL_PARTS, f"select {ID}, domain from p"),
        "network_host": with_(ALL_URLS, f"select {ID}, {HOST.format(u='url')} as network_host from all_urls"),
        "apex_domain": with_(ALL_PARTS, f"select {ID}, apex from p"),
        "feat_v4_ratios": with_(ALL_V4, f"select {ID}, url_length, domain_length, round(digit_ratio, 6) as digit_ratio, round(special_ratio, 6) as special_ratio from f"),
        "feat_v4_structure": with_(ALL_V4, f"select {ID}, num_subdomains::bigint as num_subdomains, has_ip::bigint as has_ip, has_suspicious_tld::bigint as has_suspicious_tld from f"),
        "feat_entropy": with_(ALL_V4, f"select {ID}, round(entropy, 6) as entropy, round(url_entropy, 6) as url_entropy from f"),
        "feat_brand": with_(ALL_V4, f"select {ID}, brand_dist, matched_brand from f"),
        "feat_lures": with_(ALL_V4, f"select {ID}, array_to_string(list_transform(lures, lambda m: m.c || ':' || m.k), ',') as lures, has_sensitive_keywords::bigint as has_sensitive_keywords from f"),
        "feat_homograph": with_(ALL_V4, f"select {ID}, is_punycode::bigint as is_punycode from f"),
        "feat_dga": with_(ALL_V4, f"select {ID}, dga_score from f"),
        "feat_vector_v4": with_(ALL_V4, f"select {ID}, {vector('v4')} from f"),
        "feat_train10": with_(ALL_PARTS + "," + features_old("train", "split_part(list_last(string_split(canonical, '://')), '/', 1)"), f"select {ID}, {vector('train')} from o"),
        "feat_v3_17": with_(ALL_PARTS + "," + features_old("v3", "netloc"), f"select {ID}, {vector('v3')} from o"),
        "feat_payload": f"""select doc_id, round({entropy('text')}, 5) as shannon_entropy, length(text) as char_length,
            round({share(count('text', DIGIT), 'length(text)')}, 5) as digit_ratio,
            round({share(count('text', '[^\\p{L}\\p{N}]'), 'length(text)')}, 5) as special_char_ratio,
            round({share(count('text', '\\p{Lu}'), 'length(text)')}, 5) as uppercase_ratio from documents""",
        "brand_lookalikes": with_(ALL_V4, "select label, any_value(matched_brand) as brand, any_value(brand_dist) as distance, count(*) as n_urls from f where brand_dist between 1 and 3 group by label"),
        "brand_table": with_(ALL_PARTS, """, w as (select distinct doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) as brand from documents),
            brands as (select brand from w group by brand having count(*) * 100 >= (select count(*) from documents)),
            labels as (select split_part(host, '.', 1) as label, count(*) as n_urls from p group by 1 having label <> ''),
            x as (select label, n_urls, brand, levenshtein(regexp_replace(label, '[^\\x00-\\x7F]', '~', 'g'), brand) as distance from labels, brands
              where abs(length(label) - length(brand)) <= 3)
            select label, arg_min(brand, (distance, brand)) as brand, min(distance)::bigint as distance, n_urls from x where distance <= 3
            group by label, n_urls having min(distance) >= 1"""),
        "lure_counts": with_(ALL_V4, "select t.c as category, t.k as keyword, count(*) as n from (select unnest(lures) as t from f) group by all"),
        "allow_match": with_(ALL_PARTS + "," + ONE_PAGE_ALLOW, f"select {ID}, (case when domain in (select domain from allow) or apex in (select domain from allow) then 1 else 0 end) as listed from p"),
        "allow_suffix": with_(ALL_PARTS + "," + SUFFIXES, f"select {ID}, e.suffix from p left join ended e on e.domain = p.domain"),
        "allow_pattern": with_(ALL_PARTS, f"select {ID}, {trusted('domain')}::int as trusted from p"),
        "allow_guard": with_(ALL_PARTS, f"select {ID}, domain from p where not {guarded('domain')}"),
        "allow_decision": with_(ALL_PARTS, f"select {ID}, {allowed('domain', 'apex')}::int as allowed from p"),
        "allow_decision_strict": with_(SCANS + ", u as (select scan_id, case when scan_id % 2 = 0 then regexp_replace(url, '(?i)^( *https?://)', '\\1google.com:x@') else url end as url from scans)," + parts("u", "p"),
            f"""select scan_id, domain, {allowed('domain', 'apex')}::int as allowed,
            {allowed('strict_domain', apex("string_split(strict_domain, '.')", 'strict_domain'))}::int as allowed_strict from p"""),
        "allow_rejects": with_(ALL_PARTS, f"select {ID}, url from p where not {allowed('domain', 'apex')}"),
        "allow_add": with_(ALL_PARTS + "," + BASE_ALLOW, f"select domain from base_allow union select trim(lower(netloc), {WS}) from p where netloc <> '' and not {guarded('netloc')}"),
        "allow_stats": with_(ONE_PAGE_ALLOW, f"select count(*) as registered_domains, count(distinct sha256(domain)) as hash_lookups, {len(V.ALLOW_PATTERNS)}::bigint as wildcard_patterns from allow"),
        "allow_decision_v3": with_(ALL_URLS + f""",
            v3 as (select *, lower(trim(url, {WS})) as lu from all_urls),
            v3u as (select {ID}, case when starts_with(lu, 'http://') or starts_with(lu, 'https://') then lu else 'http://' || lu end as url from v3),"""
            + parts("v3u", "p"),
            f"""select {ID}, (case when split_part(netloc, ':', 1) in ({V3_LIST})
              or array_to_string(string_split(split_part(netloc, ':', 1), '.')[-2:], '.') in ({V3_LIST}) then 1 else 0 end) as allowed from p"""),
        "cache_lookup": with_(SCORED, "select scan_id, cached_verdict as verdict, cached_risk as risk_score, hit from looked"),
        "cache_upsert": with_(UPSERTED, "select url_hash, verdict, risk_score, cached_at, expires_at from upserted"),
        "cache_purge": with_(UPSERTED, "select url_hash, verdict from upserted where url_hash not in (select url_hash from scored where event_type = 'error')"),
        "cache_expire": with_(UPSERTED, "select url_hash, expires_at from upserted where expires_at >= timestamp '2024-01-30'"),
        "cache_stats": with_(SCORED, """select sum(hit)::bigint as hits, (count(*) - sum(hit))::bigint as misses,
            round(sum(hit) * 100 / count(*), 2) as hit_ratio_percent, (select count(distinct url_hash) from history) as keys from looked where not is_allowed"""),
        "cache_ttl_replay": with_(REPLAY, "select scan_id, rhit as hit from replayed where not is_allowed"),
        "batch_first_seen": with_(SCORED, "select scan_id, url_hash, (case when row_number() over (partition by url_hash order by scan_id) = 1 then 1 else 0 end) as is_first from scored"),
        "risk_heuristic": with_(ALL_V4, f"select {ID}, risk_score from f"),
        "risk_verdict": with_(ALL_V4, f"select {ID}, verdict, {verdict('risk_score', V.THRESHOLDS_V3)} as verdict_v3 from f"),
        "scan_cascade": with_(CASCADE, "select scan_id, verdict, source, risk_score, summary, subdomains, indicators, actions from results"),
        "scan_batch": with_(SCORED + ", firsts as (select *, row_number() over (partition by url_hash order by scan_id) as rn from scored), "
            + cascade("firsts", "rn > 1", "results", "verdict", "risk_score"), "select scan_id, verdict, source, risk_score from results"),
        # The rule by lists of address groups instead of a pattern for the whole address.
        "scan_rejects": f"""with x as (select doc_id, unnest(string_split(text, '.')) as piece, generate_subscripts(string_split(text, '.'), 1) - 1 as pos from documents),
            r as (select doc_id, pos, {bracket_forms("piece", "pos")} as url from x),
            f as (select *, lower(trim(url, {WS})) as u, replace(replace(replace(if(contains(u, '://'), u, 'http://' || u), chr(9), ''), chr(13), ''), chr(10), '') as full_url,
              regexp_extract(full_url, '^([a-z][a-z0-9+.-]*:)?//([^/?#]*)', 2) as n, split_part(substr(n, strpos(n, '[') + 1), ']', 1) as address,
              string_split(split_part(address, '%', 1), '::') as halves,
              list_filter(flatten(list_transform(halves, lambda x: string_split(x, ':'))), lambda x: x <> '' or len(halves) = 1) as groups,
              list_bool_and(list_transform(groups, lambda x: regexp_full_match(x, '[0-9a-f]{{1,4}}'))) is not false as hex,
              regexp_full_match(address, 'v[0-9a-f]+\\..+') or (hex and len(string_split(address, '%')) <= 2 and address[-1:] <> '%' and len(halves) <= 2 and not regexp_matches(address, ':::')
                and if(len(halves) = 2, len(groups) <= 7 and not regexp_matches(address, '^:[^:]|[^:]:$'), len(groups) = 8)) as fine from r),
            y as (select doc_id, pos, case when u = '' then 'blank url' when contains(n, '[') <> contains(n, ']') then 'unbalanced brackets in host'
              when contains(n, '[') and not fine then 'bad address in brackets' end as reason from f)
            select doc_id, pos::int as pos, reason from y where reason is not null""",
        "enrich_asn_ranges": with_(SCANS + "," + DNS + "," + RANGES, f"""select s.scan_id, coalesce(d.ip, {q(NET['no_ip'])}) as resolved_ip, n.owner
          from scans s left join dns d on d.host = lower({HOST.format(u=f'trim(s.url, {WS})')}) left join owned n on n.ip = d.ip"""),
        "enrich_asn": with_(SCANS + "," + DNS, f"select s.scan_id, {NETWORK} from scans s left join dns d on d.host = lower({HOST.format(u=f'trim(s.url, {WS})')})"),
        "mitre_tags": with_(ALL_V4 + "," + exploded(TECHNIQUES), f"select {ID}, pos::int as pos, t.id as technique_id, t.name as technique from y"),
        "indicators": with_(ALL_V4 + "," + exploded(INDICATORS), f"select {ID}, pos::int as pos, t as text from y"),
        "playbook_actions": with_(ALL_V4 + "," + exploded(ACTIONS), f"select {ID}, pos::int as pos, t as text from y"),
        "threat_summary": with_(ALL_V4, f"select {ID}, {SUMMARY} as summary from f"),
        "xai_attribution": with_(ALL_V4 + "," + exploded(XAI), f"select {ID}, pos::int as pos, t.f as feature, t.c as contribution from y"),
        "forensic_metrics": with_(ALL_V4, f"""select {ID}, printf('%.2f Bits/Char', entropy) as entropy,
            case when brand_dist <= 3 then printf('%d (%s)', brand_dist, matched_brand) else '0 (Clean)' end as brand_dist,
            printf('%d Levels', num_subdomains) as subdomains, printf('%.1f%%', digit_ratio * 100) as digit_ratio,
            printf('%.0f%%', dga_score * 100) as dga_score,
            case when is_punycode = 1 then 'Detected (Homograph Risk)' else 'Clean ASCII' end as punycode from f"""),
        "mitre_rollup": with_(ALL_V4 + "," + CATALOGUE + "," + exploded(TECHNIQUES), """select c.technique_id, c.n, k.name, k.tactic
            from (select t.id as technique_id, count(*) as n from y group by 1) c left join catalogue k using (technique_id)"""),
        "incident_report": with_(LOG, f"select id, {text(V.INCIDENT_REPORT, 'url', 'verdict', 'risk_score * 100', 'source')} as report from log"),
        "technique_report": with_(CATALOGUE_TEXT + ", " + ALL_V4 + "," + exploded(TECHNIQUES), f"""select c.technique_id, c.n,
            {text(V.TECHNIQUE_REPORT, 'k.technique_id', 'k.name', 'k.tactic', 'k.description')} as report
            from (select t.id as technique_id, count(*) as n from y group by 1) c join catalogue_text k using (technique_id)"""),
        "log_recent": with_(LOG, f"select {LOG_COLUMNS} from log order by id desc limit 50"),
        "log_detail": with_(LOG, f"""select {LOG_COLUMNS}, case when verdict = 'SAFE' then 200 else 404 end as http_status,
            case when verdict = 'MALICIOUS' then 'EXECUTED_AUTOMATED_BLOCK' else 'PASSED_PERIMETER' end as playbook_status
            from log"""),
        "log_json_back": with_(LOG, f"select {LOG_COLUMNS}, 200 as http_status, summary, indicators from log"),
        "stats_recent": with_(LOG, f"select {STATS} from (select * from log order by id desc limit 200)"),
        "stats_all": with_(LOG, f"select {STATS} from log"),
        "verdict_counts": with_(LOG, "select verdict, count(*) as n from log group by verdict"),
        "tier_counts": with_(LOG, "select regexp_extract(source, '(Tier-\\d+)', 1) as tier, count(*) as n from log group by 1"),
        "log_json": with_(LOG, "select id, to_json({'id': id, 'url': url, 'verdict': verdict, 'source': source, 'resolved_ip': resolved_ip, 'asn_owner': asn_owner, 'http_status': 200})::varchar as log_json from log"),
        "stream_scan": with_(REPLAY + "," + cascade("replayed", "rhit = 1", "results", "verdict", "risk_score"), "select scan_id, url, verdict, source, risk_score, summary from results"),
        "stream_ttl_state": with_(REPLAY, "select scan_id, rhit as hit from replayed where not is_allowed"),
        "stream_stats": with_(SCORED, "select date_trunc('hour', ts) as window_start, verdict, count(*) as n, round(avg(latency), 6) as avg_latency from scored group by 1, 2"),
        "ngrams_char": with_(ALL_URLS + "," + char_terms("all_urls", "corpus, url_id"), "select corpus, term, count(*) as tf from grams group by 1, 2"),
        "ngrams_word": with_(ALL_URLS + "," + WORD_GRAMS, "select corpus, term, count(*) as tf from wgrams group by 1, 2"),
        "tfidf_vocab": with_(ALL_URLS + "," + char_terms("all_urls", "corpus, url_id"), "select term, count(*) as tf from grams group by term order by tf desc, term limit 1200"),
        "tfidf_weights": with_(ALL_URLS + "," + char_terms("all_urls", "corpus, url_id") + """,
            tf as (select corpus, url_id, term, count(*) as n from grams group by 1, 2, 3),
            vocab as (select term, count(*) as df from tf group by term order by sum(n) desc, term limit 1200),
            w as (select corpus, url_id, term, n * (ln((1 + (select count(*) from all_urls)) / (1 + df)::double) + 1) as x
              from tf join vocab using (term))""",
            "select corpus, url_id, term, round(x / sqrt(sum(x * x) over (partition by corpus, url_id)), 6) as weight from w"),
        "scale_standard": with_(PAYLOADS, f"select doc_id, {', '.join(standard(c) for c in PAYLOAD_FEATURES)} from payloads"),
        "binary_metrics": with_(SCORED, """select round((tp + tn) / (tp + fp + fn + tn)::double, 6) as accuracy,
            round(tp / (tp + fp)::double, 6) as precision, round(tp / (tp + fn)::double, 6) as recall,
            round(2 * tp / (2 * tp + fp + fn)::double, 6) as f1, round(wins / ((tp + fn) * (fp + tn)), 6) as roc_auc
            from (select count(*) filter (where is_phishing = 1 and risk_score >= 0.4) as tp,
              count(*) filter (where is_phishing = 0 and risk_score >= 0.4) as fp,
              count(*) filter (where is_phishing = 1 and risk_score < 0.4) as fn,
              count(*) filter (where is_phishing = 0 and risk_score < 0.4) as tn from scored),
            (select sum(r) - count(*) * (count(*) + 1) / 2.0 as wins from (select is_phishing,
              rank() over (order by risk_score) + (count(*) over (partition by risk_score) - 1) / 2.0 as r from scored) where is_phishing = 1)"""),
        "extra_tree": with_(PAYLOADS + "," + extra_tree(PAYLOAD_FEATURES, 2, 2), "select * from nodes"),
        "prep_features": with_(PAYLOADS, "select * from payloads"),
        "split_stratified": with_(SPLITS, "select doc_id, target, split, fold from splits"),
        "scale_robust": with_(PAYLOADS + "," + SPLITS + ", data as (select p.*, split from payloads p join splits s using (doc_id)), fit as (select * from data where split = 'train')",
            f"select doc_id, split, {', '.join(robust(c) for c in PAYLOAD_FEATURES)} from data"),
        "quantile_sketch": """select event_type, prob, count(value) as n, true as within
            from events, (select unnest([0.01, 0.25, 0.5, 0.75, 0.99])::double as prob) group by 1, 2""",
        "power_yeojohnson": with_(yj_search("(select round(-10 + i * 0.05::double, 10) as lam from range(401) t(i))", 0)
            + "".join("," + yj_search(f"(select round(lam + i * {step}::double, 10) as lam from best{k - 1}, range(-10, 11) t(i))", k)
                      for k, step in ((1, 0.005), (2, 0.0005))) + f""",
            best as (from best2),
            y as (select event_id, lam, {YJ.format(x='value', l='lam')} as value from events, best)""",
            f"select event_id, lam, {standard('value')} from y"),
        "class_balance": with_(SPLITS, "select 'all' as stage, target, count(*) as n from splits group by 1, 2 union all select 'train', target, count(*) from splits where split = 'train' group by 1, 2"),
        "tomek_links": """with d as (select a.vec_id as id, b.vec_id as other, a.label as la, b.label as lb,
              round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: pow(z[1]::double - z[2]::double, 2))), 9) as dist
              from embeddings a join embeddings b on a.vec_id <> b.vec_id),
            nn as (select id, other, la, lb from d qualify row_number() over (partition by id order by dist, other) = 1)
            select x.id, x.other from nn x join nn y on x.id = y.other and x.other = y.id where x.id < x.other and x.la <> x.lb""",
    }
    return sql
