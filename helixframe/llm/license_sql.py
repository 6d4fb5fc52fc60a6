"""The license scan in DuckDB's SQL, written on its own: tables of sentences, names and rules that sentences are joined with."""

SCAN = r"""
with recursive sentence(pos, id, has) as (values
  (1, 'Copyright', '\bcopyright (c )?[0-9][0-9][0-9][0-9]\b'),
  (2, 'AllRights', '\ball rights reserved\b'),
  (3, 'Secret', '\b(proprietary and confidential|unauthorized copying of this file)\b'),
  (4, 'MITtitle', '^(the )?mit license( mit)?($| copyright)'),
  (5, 'MITref', '\b(of|by|under) (the )?(terms of )?(the )?(x11|expat|mit) license\b'),
  (6, 'MITperm', '\bpermission is hereby granted free of charge to any person obtaining a copy\b'),
  (7, 'MITnotice', '\babove copyright notice and this permission notice shall be included in all copies\b'),
  (8, 'MITasis', '\bthe software is provided as is without warranty of any kind\b'),
  (9, 'MITliab', '\bin no event shall the authors or copyright holders be liable for any claim\b'),
  (10, 'BSDcond', '\bredistribution and use in source and binary forms with or without modification are permitted\b'),
  (11, 'BSDsource', '\bredistributions of source code must retain the above copyright notice\b'),
  (12, 'BSDbinary', '\bredistributions in binary form must reproduce the above copyright notice\b'),
  (13, 'BSDadvert', '\ball advertising materials mentioning features or use of this software must display\b'),
  (14, 'BSDendorse', '\bnames? of .*may (not )?be used to endorse or promote products\b'),
  (15, 'BSDasis', '\bthis software is provided by .*as is and any express or implied warranties\b'),
  (16, 'BSDliab', '\bin no event shall .*be liable for any direct indirect incidental\b'),
  (17, 'BSD4ref', '\b((four|4) clause|original) bsd license\b|\bbsd 4 clause\b'),
  (18, 'BSD3ref', '\b((three|3) clause|new|revised|modified) bsd license\b|\bbsd 3 clause\b'),
  (19, 'BSD2ref', '\b((two|2) clause|simplified) bsd license\b|\bbsd 2 clause\b|\bfreebsd license\b'),
  (20, 'ISCperm', '\bpermission to use copy modify and (or )?distribute this software for any purpose with or without fee is hereby granted provided that\b'),
  (21, 'ZeroPerm', '\bpermission to use copy modify and (or )?distribute this software for any purpose with or without fee is hereby granted$'),
  (22, 'ISCasis', '\bthe software is provided as is and the author disclaims all warranties\b'),
  (23, 'ISCref', '\bisc license\b'),
  (24, 'ZlibPerm', '\bpermission is granted to anyone to use this software for any purpose including commercial applications\b'),
  (25, 'ZlibRef', '\bzlib license\b'),
  (26, 'ApacheComply', '\bmay not use this file except in compliance with the license\b'),
  (27, 'ApacheBasis', '\bunless required by applicable law or agreed to in writing software distributed under the license\b'),
  (28, 'Apache-2.0', '\bapache 2 0 license\b|\bunder (the )?apache 2 0\b'),
  (29, 'NoWarranty', '\bwithout any warranty without even the implied warranty of merchantability\b'),
  (30, 'Boost', '\bboost software license\b'),
  (31, 'Public', '\b(free and unencumbered software released into the public domain|under the unlicense)\b'),
  (32, 'CC0', '\b(cc0|creative commons zero|public domain dedication)\b'),
  (33, 'WTFPL', '\b(wtfpl|do what the [a-z]+ you want to public license)\b')),
family(pos, name, called, later) as (values
  (41, 'AGPL', '((gnu )?affero general public license|(gnu )?agpl)', true),
  (42, 'LGPL', '(gnu (lesser|library) general public license|(gnu )?lgpl)', true),
  (43, 'GPL', '(gnu general public license|(gnu )?gpl)', true),
  (44, 'Apache', '(apache (software )?license|apache org licenses license)', false),
  (45, 'MPL', '(mozilla public license|mpl)', false),
  (46, 'EPL', '(eclipse public license|epl)', false)),
rule(pos, license, pattern) as (values
  (1, 'BSD-4-Clause', '(<Copyright>)*(<AllRights>)?(<Copyright>)*<BSDcond>(<BSDsource>)?(<BSDbinary>)?<BSDadvert>(<BSDendorse>)?(<BSDasis>)?(<BSDliab>)?|<BSD4ref>'),
  (2, 'BSD-3-Clause', '(<Copyright>)*(<AllRights>)?(<Copyright>)*<BSDcond>(<BSDsource>)?(<BSDbinary>)?<BSDendorse>(<BSDasis>)?(<BSDliab>)?|<BSD3ref>'),
  (3, 'BSD-2-Clause', '(<Copyright>)*(<AllRights>)?(<Copyright>)*<BSDcond>(<BSDsource>)?(<BSDbinary>)?(<BSDasis>)?(<BSDliab>)?|<BSD2ref>'),
  (4, 'MIT', '(<MITtitle>)?(<Copyright>)*(<AllRights>)?(<Copyright>)*<MITperm>(<MITnotice>)?(<MITasis>)?(<MITliab>)?|<MITref>|<MITtitle>'),
  (5, 'ISC', '(<ISCref>)?(<Copyright>)*(<AllRights>)?(<Copyright>)*<ISCperm>(<ISCasis>)?|<ISCref>'),
  (6, '0BSD', '(<Copyright>)*(<AllRights>)?(<Copyright>)*<ZeroPerm>(<ISCasis>)?'),
  (7, 'Zlib', '(<ZlibRef>)?(<Copyright>)*(<AllRights>)?(<Copyright>)*<ZlibPerm>|<ZlibRef>'),
  (8, 'BSL-1.0', '(<Copyright>)*(<AllRights>)?(<Copyright>)*<Boost>'),
  (9, 'Unlicense', '<Public>'),
  (10, 'CC0-1.0', '<CC0>'),
  (11, 'WTFPL', '(<Copyright>)*(<AllRights>)?(<Copyright>)*<WTFPL>')),
doc as (select row_number() over () as n, doc_id, coalesce(text, '') as text from documents),
bare as (select n, regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)),
    '(?m)^[ \t]*(//+|/\*+|\*+/?|#+|;+|--+|%+|<!--|"{3}|''{3})[ \t]*', '', 'g') as t
  from doc where regexp_matches(lower(text), 'licen|right|gpl|mpl|epl|commons|cc|redistribut|advertis|endorse|permission|warrant|liable|public|confidential|unauthorized|apache|bsd|wtfpl')),
marked as (select n, regexp_replace(regexp_replace(regexp_replace(t, '(?i)(spdx-license-identifier:[^\n]*)', E'\n\n\\1\n\n', 'g'),
    '(?i)\bv(ers|er)?\. ?([0-9])', 'version \2', 'g'), '[.!?](\s|$)', E'\n\n', 'g') as t from bare),
cut as (select n, regexp_split_to_array(t, '\n[ \t]*\n') as l from marked),
piece as (select n, unnest(l) as own, unnest(range(len(l))) as place from cut),
said as (select n, place, own, own ilike '%spdx-license-identifier:%' as tagged,
    trim(regexp_replace(trim(regexp_replace(lower(own), '[^a-z0-9+]+', ' ', 'g')),
      '\b(not|never|no longer|isn t|aren t)( [a-z]+)? (licensed|released|distributed|available|offered|published|covered|provided) (under|by|with)\b.*?( but |$)', ' ', 'g')) as s
  from piece),
mention as (
  select n, place, pos, name, later, unnest(m) as m, unnest(range(len(m))) as k from (
    select n, place, pos, name, later, regexp_extract_all(s, '\b' || called ||
      '(v?[0-9]\b|v?[0-9] [0-9]\b|\b(( as published by the free software foundation)?( either)?( version)? ?v? ?[0-9]( [0-9])?\b)?)' ||
      '(( of the license| as published by the free software foundation)*( or at your option any later version| or any later version| or later|\+))?') as m
    from said, family where not tagged)
  union all
  select n, place, 50, 'CC-BY', false, unnest(m), unnest(range(len(m))) from (
    select n, place, regexp_extract_all(s,
      '\b(creative commons attribution|cc by)( non ?commercial| nc)?( share ?alike| sa| no ?derivs| no ?derivatives| nd)?( [0-9] [0-9])?\b') as m
    from said where not tagged)),
numbered as (select *, replace(regexp_extract(m, '[0-9]( [0-9])?'), ' ', '.') as v from mention),
known as (
  select n, place, pos, 0 as k, id from said join sentence on regexp_matches(s, has) where not tagged
  union all
  select n, place, pos, k, case
    when pos = 50 then 'CC-BY' || case when regexp_matches(m, ' non ?commercial| nc') then '-NC' else '' end
      || case when regexp_matches(m, ' share ?alike| sa') then '-SA' else '' end
      || case when regexp_matches(m, ' no ?deriv| nd') then '-ND' else '' end || case when v = '' then '' else '-' || v end
    when v = '' then name
    else name || '-' || v || case when length(v) = 1 then '.0' else '' end
      || case when not later then '' when regexp_matches(m, '(later|later version|\+)$') then '-or-later' else '-only' end end
  from numbered
  union all
  select n, place, 60, k, 'SPDX=' || w from (
    select n, place, unnest(ws) as w, unnest(range(len(ws))) as k from (
      select n, place, regexp_split_to_array(regexp_replace(regexp_extract(own, '(?i)spdx-license-identifier:[ \t]*([A-Za-z0-9.+() \t-]*)', 1),
        '(?i)\bwith[ \t]+[^ \t()]+', ' ', 'g'), '[() \t]+') as ws from said where tagged))
  where regexp_matches(w, '^[A-Za-z0-9][A-Za-z0-9.+-]*$') and lower(w) not in ('or', 'and')),
line as (select n, string_agg(id, ',' order by place, pos, k) as ids, string_agg('<' || id || '>', '' order by place, pos, k) as rest from known group by n),
walk as (
  select n, ids, 0 as pos, rest, []::varchar[] as found from line
  union all
  select n, ids, rule.pos, regexp_replace(rest, pattern, '', 'g'), case when regexp_matches(rest, pattern) then list_append(found, license) else found end
  from walk join rule on rule.pos = walk.pos + 1),
rest as (select n, ids, rest, found, list_filter(regexp_extract_all(rest, '<([^>]*)>', 1), lambda i:
    regexp_matches(i, '^((AGPL|LGPL|GPL|Apache|MPL|EPL)-|CC-BY|SPDX=)')
    or (i in ('AGPL', 'LGPL', 'GPL', 'Apache', 'MPL', 'EPL') and not contains(rest, '<' || i || '-'))) as named
  from walk where pos = 11),
every as (select n, ids, list_concat(list_concat(list_transform(named, lambda i: regexp_replace(i, '^SPDX=', '')), found),
    case when regexp_matches(rest, '<(AllRights|Secret)>') then ['Proprietary'] else []::varchar[] end) as l from rest),
once as (select n, ids, list_filter(l, lambda x, i: list_position(l, x) = i) as l from every)
select doc_id, coalesce(ids, '') as sentence_ids, coalesce(array_to_string(l, ','), '') as licenses, coalesce(len(l), 0)::bigint as n_licenses
from doc left join once using (n)
"""
