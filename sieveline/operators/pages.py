"""The scripts and styles of the HTML pages: search, chips and sorting happen in the browser."""

from __future__ import annotations

STYLE = """
body { font: 15px/1.5 system-ui, sans-serif; margin: 2rem auto; max-width: 75rem; padding: 0 1rem; color: #222; }
table { border-collapse: collapse; width: 100%; }
th, td { border: 1px solid #ccc; padding: .3rem .5rem; text-align: left; vertical-align: top; }
th { background: #f3f3f3; cursor: pointer; position: sticky; top: 0; }
input[type=search] { width: 100%; padding: .4rem; margin: .5rem 0; box-sizing: border-box; }
.tiles { display: flex; flex-wrap: wrap; gap: 1rem; } .tile { border: 1px solid #ccc; padding: .5rem 1rem; } .tile b { display: block; font-size: 1.5rem; }
.chip[aria-pressed=true] { background: #222; color: #fff; } .mismatch { color: #a11; } .partial { color: #960; } .match { color: #175; }
"""

#: A list whose items carry data-search (and data-kind): a search field and boxes of kinds hide what does not fit.
FILTER = """
function fitting(list, field, boxes) {
  const show = () => {
    const term = field.value.toLowerCase(), kinds = boxes.filter(b => b.checked).map(b => b.value);
    for (const item of list) item.hidden = !(item.dataset.search.includes(term) && (!boxes.length || kinds.includes(item.dataset.kind)));
  };
  field.addEventListener('input', show);
  for (const b of boxes) b.addEventListener('change', show);
}
fitting([...document.querySelectorAll('[data-search]')], document.querySelector('#search'), [...document.querySelectorAll('.kind')]);
"""

#: A click on a column's head sorts a table's rows by its text, another one turns the order round.
SORT = """
for (const head of document.querySelectorAll('th')) head.addEventListener('click', () => {
  const body = head.closest('table').tBodies[0], at = head.cellIndex, up = head.dataset.up !== 'yes';
  for (const other of head.parentNode.cells) delete other.dataset.up;
  head.dataset.up = up ? 'yes' : 'no';
  const text = row => row.cells[at].innerText.toLowerCase();
  body.append(...[...body.rows].sort((a, b) => (up ? 1 : -1) * text(a).localeCompare(text(b))));
});
"""

#: The overview: both tables stand in as JSON for the two marks.
OVERVIEW = (
    """<!doctype html><html><head><meta charset="utf-8"><title>Papers</title><style>"""
    + STYLE
    + """</style></head><body>
<h1>Papers</h1><div class="tiles" id="tiles"></div>
<p><button class="chip" data-of="papers" data-chip="all" aria-pressed="true">all</button> <button class="chip" data-of="papers" data-chip="matched" aria-pressed="false">matched</button>
<button class="chip" data-of="papers" data-chip="missing" aria-pressed="false">missing</button></p>
<input type="search" id="find-papers" placeholder="ID, title, authors, DOI or what was recorded"><table><thead><tr id="heads-papers"></tr></thead><tbody id="papers"></tbody></table>
<h2>Verdicts</h2>
<p><button class="chip" data-of="verdicts" data-chip="all" aria-pressed="true">all</button> <button class="chip" data-of="verdicts" data-chip="mismatch" aria-pressed="false">mismatch</button>
<button class="chip" data-of="verdicts" data-chip="partial" aria-pressed="false">partial</button> <button class="chip" data-of="verdicts" data-chip="unverifiable" aria-pressed="false">unverifiable</button>
<button class="chip" data-of="verdicts" data-chip="match" aria-pressed="false">match</button></p>
<input type="search" id="find-verdicts" placeholder="paper, field, modality or explanation"><table><thead><tr id="heads-verdicts"></tr></thead><tbody id="verdicts"></tbody></table>
<script>
const RANK = {mismatch: 0, partial: 1, unverifiable: 2, match: 3};
const text = x => x == null ? '' : String(x);
const number = x => x == null ? -1 : x;
const byId = (a, b) => { const [p, n] = text(a).split('-'), [q, m] = text(b).split('-'); return p.localeCompare(q) || (parseInt(n) || 0) - (parseInt(m) || 0); };
const views = {
  papers: {rows: __DATA_JSON__, chip: 'all', term: '', key: 'id', down: false, shown: ['id', 'title', 'authors', 'year', 'doi', 'anatomical_text', 'photometry_text', 'ephys_text', 'matched', 'confidence', 'match_method'],
    searched: ['id', 'title', 'authors', 'doi', 'anatomical_text', 'photometry_text', 'ephys_text'], fits: (r, c) => c === 'all' || r.matched === (c === 'matched')},
  verdicts: {rows: __VERIFICATION_JSON__, chip: 'all', term: '', key: 'verdict', down: false, shown: ['paper_id', 'modality', 'field_name', 'verdict', 'confidence', 'explanation', 'evidence_quote'],
    searched: ['paper_id', 'field_name', 'modality', 'explanation'], fits: (r, c) => c === 'all' || r.verdict === c},
};
function compared(view, a, b) {
  const x = a[view.key], y = b[view.key];
  if (view.key === 'id') return byId(x, y);
  if (view.key === 'verdict') return (RANK[x] ?? 9) - (RANK[y] ?? 9);
  if (view === views.papers && (view.key === 'confidence' || view.key === 'matched')) return number(x) - number(y);
  return text(x).toLowerCase().localeCompare(text(y).toLowerCase());
}
function cell(row, key) {
  const td = document.createElement('td');
  let shown = text(row[key]);
  if (key === 'evidence_quote' && shown.trim().toLowerCase() === 'not explicitly stated') shown = '';
  if (key === 'doi' && shown) { const a = document.createElement('a'); a.textContent = shown.replace(/^https?:\\/\\/(dx\\.)?doi\\.org\\//, ''); a.href = 'https://doi.org/' + a.textContent; td.append(a); return td; }
  td.textContent = shown;
  if (key === 'verdict') td.className = shown;
  return td;
}
function draw(name) {
  const view = views[name], term = view.term.toLowerCase();
  const rows = view.rows.filter(r => view.fits(r, view.chip) && (!term || view.searched.some(k => text(r[k]).toLowerCase().includes(term))));
  rows.sort((a, b) => (view.down ? -1 : 1) * compared(view, a, b));
  document.querySelector('#' + name).replaceChildren(...rows.map(r => { const tr = document.createElement('tr'); tr.append(...view.shown.map(k => cell(r, k))); return tr; }));
}
for (const name of Object.keys(views)) {
  const view = views[name], heads = document.querySelector('#heads-' + name);
  for (const key of view.shown) { const th = document.createElement('th'); th.textContent = key; th.onclick = () => { view.down = view.key === key && !view.down; view.key = key; draw(name); }; heads.append(th); }
  document.querySelector('#find-' + name).oninput = e => { view.term = e.target.value; draw(name); };
  draw(name);
}
for (const chip of document.querySelectorAll('.chip')) chip.onclick = () => {
  for (const other of document.querySelectorAll(`.chip[data-of=${chip.dataset.of}]`)) other.setAttribute('aria-pressed', other === chip);
  views[chip.dataset.of].chip = chip.dataset.chip; draw(chip.dataset.of);
};
const P = views.papers.rows, W = views.verdicts.rows, count = (rows, f) => rows.filter(f).length;
const tiles = {papers: P.length, matched: count(P, r => r.matched), missing: count(P, r => !r.matched), audited: new Set(W.map(r => r.paper_id)).size, mismatches: count(W, r => r.verdict === 'mismatch'), partials: count(W, r => r.verdict === 'partial')};
document.querySelector('#tiles').append(...Object.entries(tiles).map(([k, v]) => { const d = document.createElement('div'); d.className = 'tile'; d.innerHTML = '<b></b>'; d.firstChild.textContent = v; d.append(k); return d; }));
</script></body></html>"""
)


def page(title: str, body: str, *scripts: str) -> str:
    code = f"<script>{''.join(scripts)}</script>" if scripts else ""
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{title}</title><style>{STYLE}</style></head><body><h1>{title}</h1>{body}{code}</body></html>"
